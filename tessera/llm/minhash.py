"""MinHash near-dedup with tensored banding.

Two collections of ``m`` bands, each of ``k`` minhashes, are computed for a document;
its m * m table keys pair one band of the first with one of the second.  So 2mk
minhashes serve m * m tables of 2k each, about the square root of what separate
tables would need.  ``m`` follows from the threshold so that a pair at the threshold
shares a key with probability ``recall``.

1. One pass over the texts: bands, number of distinct shingles, and a 128-bit hash of
   the set.  Documents with equal sets become one node.
2. Nodes that share a band of either collection with another get their table keys;
   each key's smallest node is its hub.  Hub edges, by connected components, give
   clusters: nodes with a common key are in one cluster.
3. A cluster of more than ``block`` nodes is narrowed first, in rounds.  Each node is
   compared with the hub of one of its keys, and what links is united.  Then only keys
   that hold nodes of two components or more are left, and only nodes with such a key.
   Rounds go on while each leaves at most half of the nodes; what is left is clustered
   anew.  A round sends each node's text once, so a large group costs in proportion.
4. Each cluster's texts are sent once to its blocks.  There every pair with a common
   key is confirmed on the full shingle sets, unless links found before already
   connect it.  A cluster is cut into blocks of ``block`` nodes, fewer where they are
   long, and each pair of blocks is a task's group, so no cluster, whatever its size,
   meets in one task.  A group's texts are shingled step by step: only hashes are held.
5. Connected components of the confirmed links.

Words are runs of other bytes than space and \\t \\n \\v \\f \\r, A-Z lower-cased.  With
fewer words than a shingle has, the whole sequence is the one shingle; without words
the set is empty and links with nothing.  Shingles are compared by 64-bit hashes.

Cases: a null or empty text, or a null id, stays alone; repeated rows and rows that
share an id are one node; very long texts are whole; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, discard, lean, mix64, runs, save, solely, text_slices

K = 4
RECALL = 0.9985
BLOCK = 1024
#: Shingles of a block, about: long texts make more blocks.
BLOCK_SHINGLES = 1_000_000


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, one after another, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, owner = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word
    coded = pc.cast(words.filter(full), pa.binary()).dictionary_encode()
    kinds = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, kinds), np.uint64, len(kinds))[coded.indices.to_numpy()]
    counts = np.bincount(owner.filter(full).to_numpy(zero_copy_only=False), minlength=len(texts))
    out = []
    for h in np.split(hashes, np.cumsum(counts)[:-1]):
        n = len(h)
        if n:
            size = min(width, n)
            with np.errstate(over="ignore"):
                acc = np.full(n - size + 1, 0x9E3779B97F4A7C15 + size, np.uint64)
                for d in range(size):
                    acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + h[d : d + n - size + 1])
            h = np.unique(acc)
        out.append(h)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array([len(h) for h in out], np.int64)


def group_sets(texts: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets of the texts of a group, of which words are made for one step at a time."""
    made = [shingle_sets(b.column("text"), width) for b in text_slices(pa.table({"text": texts}).to_batches(), "text")]
    return tuple(np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((np.uint64, np.int64), zip(*made, strict=True), strict=True))


def bands_for(num: int, den: int, k: int = K, recall: float = RECALL) -> int:
    """How many bands a collection needs so that pairs at the threshold num/den share a table key with probability recall."""
    p, m = (num / den) ** k, 1
    while (1 - (1 - p) ** m) ** 2 < recall:
        m += 1
    return m


def band_hashes(flat: np.ndarray, counts: np.ndarray, m: int, k: int = K) -> np.ndarray:
    """(documents, 2m) hashes of bands of k minhashes each; documents must have shingles."""
    starts = np.cumsum(counts) - counts
    rng = np.random.default_rng(2024)
    out = np.zeros((len(counts), 2 * m), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(2 * m):
            acc = np.full(len(counts), band + 1, np.uint64)
            for _ in range(k):
                x, a = rng.integers(1, 2**63, 2, dtype=np.uint64)
                least = np.minimum.reduceat((flat ^ x) * (a | np.uint64(1)), starts)
                acc = mix64(acc * np.uint64(0x9FB21C651E98DF25) + least)
            out[:, band] = acc
    return out


def _signatures(docs: DataFrame, width: int, m: int) -> DataFrame:
    """(doc, s1, s2, n, bands): s1, s2 hash the set; null ids, and documents without words, are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solely(None)
        for b in text_slices(batches, "text"):
            flat, counts = shingle_sets(b.column("text"), width)
            has = counts > 0
            if not has.any():
                continue
            counts = counts[has]
            starts = np.cumsum(counts) - counts
            with np.errstate(over="ignore"):
                s1 = mix64(np.add.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), starts))
                s2 = mix64(np.add.reduceat(mix64(flat + np.uint64(0x14057B7EF767814F)), starts))
            bands = band_hashes(flat, counts, m)
            at = pa.array(np.arange(0, bands.size + 1, 2 * m, dtype="i4"))
            own = b.column("doc").filter(pa.array(has))
            yield pa.RecordBatch.from_arrays([own, pa.array(s1.view("i8")), pa.array(s2.view("i8")), pa.array(counts), pa.ListArray.from_arrays(at, pa.array(bands.view("i8").ravel()))], names=["doc", "s1", "s2", "n", "bands"])

    return docs.where("doc is not null and text is not null").mapInArrow(run, "doc long, s1 long, s2 long, n long, bands array<long>")


def _tables(nodes: DataFrame, m: int) -> DataFrame:
    """(node, key): the table keys of nodes that share a band of each collection with others."""
    single = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    shared = single.groupBy("band", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "h")
    hit = single.join(shared, ["band", "h"], "left_semi").groupBy("node").agg(F.collect_set("band").alias("own"))
    tables = nodes.join(hit, "node").select("node", "bands", F.filter("own", lambda x: x < m).alias("left"), F.filter("own", lambda x: x >= m).alias("right"))
    tables = tables.select("node", "bands", "right", F.explode("left").alias("i")).select("node", "bands", "i", F.explode("right").alias("j"))
    return tables.select("node", F.xxhash64("i", "j", F.get("bands", F.col("i")), F.get("bands", F.col("j"))).alias("key"))


def _candidates(tables: DataFrame) -> DataFrame:
    """Edges (a, b) from each table key's smallest node to its others."""
    hubs = tables.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "hub")
    return tables.join(hubs, "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()


def _within(mask: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each stretch are true; stretches may be empty."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[starts + counts] - total[starts]


def _spokes(group: pa.Table, width: int, num: int, den: int) -> np.ndarray:
    """The nodes of a group that are linked with its hub, which is in the group."""
    node, hub = group["node"].to_numpy(), group["hub"][0].as_py()
    flat, counts = group_sets(group["text"], width)
    starts, linked = np.cumsum(counts) - counts, np.zeros(len(node), bool)
    for h in np.flatnonzero((node == hub) & (counts > 0)).tolist():  # several where rows share an id
        inter = _within(np.isin(flat, flat[starts[h] : starts[h] + counts[h]]), starts, counts)
        linked |= den * inter >= num * (counts[h] + counts - inter)
    return np.unique(node[linked & (node != hub)])


def _narrowed(big: DataFrame, nodes: DataFrame, texts: DataFrame, m: int, width: int, num: int, den: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(links: a, b), and (node, component, part) of the nodes of large clusters that are still to be compared: part is what links unite so far."""
    spark = big.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = save(texts.join(big.select(F.col("node").alias("doc")).distinct(), "doc", "left_semi"), "texts")
    tables = save(_tables(nodes.join(big, "node", "left_semi"), m).distinct().withColumn("part", F.col("node")), "tables")
    links, before = None, big.count()

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solely(None)
        for g in runs(batches, "hub", "salt"):
            b = _spokes(g, width, num, den)
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), g["hub"][0].as_py(), "i8")), pa.array(b)], names=["a", "b"])

    while True:
        hubs = tables.groupBy("key").agg(F.min(F.struct("part", "node")).alias("hub"))
        spokes = tables.join(hubs, "key").where("hub.part < part").groupBy("node").agg(F.min("hub").alias("hub")).select(F.col("hub.node").alias("hub"), "node")
        spokes = save(spokes, "spokes")
        salts = spokes.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("salts"))
        rows = spokes.join(salts, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node")
        own = salts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("node"))
        sent = rows.unionByName(own).join(words, F.col("node") == F.col("doc")).select("hub", "salt", "node", "text")
        found = save(sent.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt").mapInArrow(confirm, "a long, b long"), "links")
        links = found if links is None else links.unionByName(found)
        united = connected_components(links)
        now = tables.drop("part").join(united, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
        now = save(now, "tables")
        mixed = now.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("key")
        left = save(now.join(mixed, "key", "left_semi"), "tables")
        discard(tables, spokes, united, now)
        tables, after = left, left.select("node").distinct().count()
        if not after or 2 * after > before:
            break
        before = after
    clusters = connected_components(_candidates(tables.select("key", "node")))
    return links, save(clusters.join(tables.select("node", "part").distinct(), "node"), "clusters")


def _confirmed(group: pa.Table, m: int, width: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group that, with what unites its parts, span what its candidates link."""
    node, own = group["node"].to_numpy(), group["own"].to_numpy()
    i, j = group["i"][0].as_py(), group["j"][0].as_py()
    flat, counts = group_sets(group["text"], width)
    starts = np.cumsum(counts) - counts
    words, at = np.unique(flat, return_inverse=True)  # shingles as numbers from 0, for this group
    del flat
    sets = np.split(at, starts[1:])
    bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), 2 * m)
    label, mark = np.unique(group["part"].to_numpy(), return_inverse=True)[1], np.zeros(len(words), bool)
    found = []
    for x in range(len(node)):
        # each pair once; between two blocks only those across
        across = (np.arange(len(node)) > x) if i == j else (own == j) if own[x] == i else None
        if across is None:
            continue
        y = np.flatnonzero(across & (label != label[x]) & (den * np.minimum(counts, counts[x]) >= num * np.maximum(counts, counts[x])))
        if not len(y):
            continue
        same = bands[y] == bands[x]
        y = y[same[:, :m].any(1) & same[:, m:].any(1)]
        if not len(y):
            continue
        mark[sets[x]] = True
        if 4 * len(y) < len(node):
            inter = np.array([np.count_nonzero(mark[sets[z]]) for z in y.tolist()])
        else:
            inter = _within(mark[at], starts, counts)[y]
        mark[sets[x]] = False
        y = y[den * inter >= num * (counts[x] + counts[y] - inter)]
        if len(y):
            _, one = np.unique(label[y], return_index=True)  # a link to each component is enough
            found += [(node[x], node[z]) for z in y[one].tolist()]
            label[np.isin(label, label[y])] = label[x]
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return a, b


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row: links are 'den * intersection >= num * union'."""
    spark = docs.sparkSession
    lean(spark)
    m = bands_for(num, den, recall=recall)
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    signed = save(_signatures(texts, width, m), "signatures")
    classes = save(signed.groupBy("s1", "s2").agg(F.min("doc").alias("node"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.count(F.lit(1)).alias("c")), "classes")
    nodes = classes.select("node", "bands")
    united = save(connected_components(_candidates(_tables(nodes, m))), "clusters")
    sizes = united.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    clusters, narrow = united.join(sizes, "component").select("node", "component", F.col("node").alias("part"), "size"), None
    if sizes.where(F.col("size") > block).limit(1).count():
        big = save(clusters.where(F.col("size") > block).select("node"), "big")
        narrow, rest = _narrowed(big, nodes, texts, m, width, num, den, block)
        clusters = clusters.where(F.col("size") <= block).drop("size").unionByName(rest)
        sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        clusters = clusters.join(sizes, "component")
    shingles = clusters.join(classes.select("node", "n"), "node").groupBy("component").agg(F.sum("n").alias("shingles"))
    blocks = F.ceil(F.least("size", F.greatest(F.col("size") / block, F.col("shingles") / BLOCK_SHINGLES))).cast("int")
    cut = clusters.join(shingles, "component").withColumn("blocks", blocks).drop("shingles").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    whole = cut.join(nodes, "node").join(texts, F.col("node") == F.col("doc")).drop("doc")
    sent = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "part", "bands", "text")

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solely(None)
        for g in runs(batches, "component", "i", "j"):
            a, b = _confirmed(g, m, width, num, den)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = sent.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(confirm, "a long, b long")
    components = connected_components(links if narrow is None else links.unionByName(narrow))
    known = classes.join(components, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component"))
    # rows that share an id: their sets' components meet in the smallest, and the row reports the largest set
    per_doc = signed.select("doc", "s1", "s2", "n").join(known, ["s1", "s2"]).groupBy("doc").agg(F.max("n").alias("n"), F.min("component").alias("component"))
    per_doc = save(per_doc, "components")
    discard(signed, classes, united, components)
    out = texts.select("doc").join(per_doc, "doc", "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(False)).alias("kept"))
