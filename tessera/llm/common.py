"""What the operators of this subpackage share: tables, written intermediate results, batches, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir

#: Bytes of text that one step of a Python worker handles at once; a longer text makes a step of its own.
STEP_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts are long, and each batch is held by the JVM and by a worker.
BATCH_ROWS = 1000


def lean(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, for the session; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def save(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def positional(df: DataFrame) -> DataFrame:
    """df with its columns renamed _0, _1, ..., so that no name of its own clashes with a working column."""
    return df.toDF(*[f"_{k}" for k in range(len(df.columns))])


def discard(*frames: DataFrame) -> None:
    """Deletes what save() wrote, once nothing reads it any more."""
    for df in frames:
        if path := getattr(df, "_saved_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_slices(batches: Iterable[pa.RecordBatch], text: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``step`` bytes of text at most, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype("i8"))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + step, "right")))
            yield b.slice(at, to - at)
            at = to


class TwoGenerations(dict):
    """A bounded memo: what comes again moves over from the old generation, the rest is forgotten."""

    def __init__(self, make, bound: int):
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, key):
        if (got := self.old.get(key)) is None:
            got = self.make(key)
        self.put(key, got)
        return got

    def put(self, key, got) -> None:
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:  # long ones hardly come again
            self[key] = got

    def many(self, keys: list, make) -> list:
        """The values of all keys; make turns the list of those that are not known into their values."""
        out = list(map(self.get, keys))
        new = []
        for k in [k for k, x in enumerate(out) if x is None]:
            if (got := self.old.get(keys[k])) is None:
                new.append(k)
            else:
                out[k] = got
                self.put(keys[k], got)
        for k, got in zip(new, make([keys[k] for k in new]) if new else (), strict=True):
            out[k] = got
            self.put(keys[k], got)
        return out


#: White space as split patterns and Python know it; what matches is not cut.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_WHOLE = rf"{_SPACE} {_SPACE}|\x00"


def gather(table: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``codes`` of a table of stretches of the given sizes, one after another, and where each ends."""
    starts, n = np.cumsum(size) - size, size[codes]
    ends = np.cumsum(n)
    return table[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


def encode_by_pieces(texts: pa.Array, memo: TwoGenerations, many, whole) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): token ids of all texts one after another, and where each text's end; null is empty.

    A byte-level pre-tokeniser cuts at a space after a character that is no white space,
    and at the last space of a run before a word.  Only a space between two white-space
    characters may lie inside a pre-token.  So other texts are cut before each space, and
    each distinct piece is encoded once: ``many`` turns pieces, with their space, into
    ids (little-endian unsigned 32-bit), ``whole`` a text that can't be cut.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _WHOLE)
    cut = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), " ", "\x00 "), "\x00")
    coded = cut.flatten().dictionary_encode()
    parts = memo.many(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), many)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    ids, ends = gather(np.frombuffer(b"".join(parts), "<u4"), size, coded.indices.to_numpy())
    ends = np.concatenate([[0], ends])[cut.offsets.to_numpy()[1:]]
    if own := np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
        split = np.split(ids, ends[:-1])
        for k in own:
            split[k] = np.frombuffer(whole(texts[k].as_py()), "<u4")
        ids, ends = np.concatenate(split), np.cumsum([len(x) for x in split])
    return ids, ends


#: What this Python worker keeps between tasks, under the name of the operator that made it.
_kept: dict[str, object] = {}


def solely(name: str | None, make=None):
    """What the worker keeps for the operator ``name``, made where it is missing; what it keeps for others is given up.

    Workers serve one stage after another, and each stage's memos are of no use to the next.
    """
    if others := [k for k in _kept if k != name]:
        for other in others:
            del _kept[other]
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can, freed memory goes back to the system
            ctypes.CDLL(None).malloc_trim(0)
    if name is None:
        return None
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node of each one's component, by hooking and pointer jumping."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        live = ru != rv
        if not live.any():
            return nodes, nodes[root]
        u, v, ru, rv = u[live], v[live], ru[live], rv[live]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task become stars; in pieces, so that memory stays bounded."""
    solely(None)
    held, n = [], 0

    def stars():
        a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        nodes, root = forest(a, b)
        own = nodes != root
        return nodes[own], root[own]

    for x in batches:
        held.append((x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)))
        n += x.num_rows
        if n > 2_000_000:
            held = [stars()]
            n = len(held[0][0])
            if n > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["a", "b"])
                held, n = [], 0
    if held:
        a, b = stars()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


#: So many edges, 16 bytes each, are united in one task; more take the rounds.
ONE_TASK = 500_000


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b), both bigint.

    Each task first turns its edges into stars.  If ``one_task`` or fewer are left, one
    task unites them; else alternating large-star and small-star rounds do; each is a partial aggregation and a
    join on a node, so a hub costs no task more than its share.  Every round is written
    to the shared folder.  Loops and repeated edges are allowed; no edges, no rows.
    """
    e = save(edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_contract, "a bigint, b bigint"), "edges")
    state, done = None, e.count() <= one_task
    if done:
        e, rest = save(e.repartition(1).mapInArrow(_contract, "a bigint, b bigint"), "edges"), e
        discard(rest)
    while not done:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: from each node to the smallest of its smaller neighbours
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        new = save(small, "edges")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("b")).first()
        discard(e)
        e = new
        done, state = now == state, now
    # now every edge goes from a node to its root
    out = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._saved_at = e._saved_at  # discard(out) deletes the last edges
    return out


def runs(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The groups of a sorted task, one at a time: consecutive rows with equal keys (integers, not null)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, cols, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for to in cut.tolist():
            yield pa.Table.from_batches([*held, b.slice(at, to - at)])
            held, at = [], to
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)
