"""Embedding near-dedup by sorted projection passes.

Equal vectors are first folded into one node with a multiplicity.  In each pass the
nodes are ordered lexicographically by the concatenated signs of 63 random
projections, and each is compared, in double precision, with the ``window`` nodes
that follow.  Each pass also measures for each node how many bits it takes until at
most ``window`` nodes share them: a pair at the threshold agrees on so many with a
known probability.  Passes go on over the nodes for which the product of what they
may have missed is above ``miss`` yet; nodes of dense regions take more of them.  This
holds for tables of any size.  Nodes that at the rate they measured would need more than
MOST passes are compared block against block, and miss nothing: the density around a
node decides that, the number of rows does not.  The passes of a round are one
range-sorted job; tasks pass the head of their range to the task before, so windows
cross borders.  Verified pairs are united into components.

A component may hold far more vectors than a window.  So within each component,
block against block, every vector is compared with every other: this gives the exact
number of links of a vector, and costs no row for a pair.  Components of any size are
cut into blocks of ``block`` nodes; larger ones into larger blocks, up to ``WIDEST``, so
that a vector is sent to about as many blocks as the square root of the tasks.

Cases: a vector that is null, zero or has null or non-finite components links with
nothing, likewise one with a null id; vectors of different lengths never link; rows
with equal vectors are all linked; rows that share an id are one node of the
components; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, forest, runs, save

BITS = 63
WINDOW = 96
MISS = 0.001
BLOCK = 512
#: What a node costs in a pass (two shuffles, a sort, a window), in comparisons of two vectors, and what its passes may cost.
PASS_COST = 2000
WORTH = 400_000
#: Rows of a task of a round of passes, so that few lie at an edge, where a task can't measure.
TASK_ROWS = 8192
#: Nodes of a block where all nodes left are compared.
REST_BLOCK = 2048
#: Nodes of a block of the largest components; smaller ones have as many pairs of blocks as the job has tasks, or blocks of BLOCK.
WIDEST = 16_384


def passes_for(nodes: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold has met with probability 1 - miss among evenly spread nodes: the first guess.

    Two nodes meet in a pass if their signs agree for so long that at most ``window``
    nodes share that beginning.
    """
    agree = _agree(threshold) ** max(0.0, math.log2(max(nodes, 1) / window))
    return 1 if agree >= 1 - miss else max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def _agree(threshold: float) -> float:
    """Probability that a random plane leaves a pair at the threshold on one side."""
    return 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi


def bits_needed(group: np.ndarray, sign: np.ndarray, window: int, first: bool = False, last: bool = False) -> np.ndarray:
    """For each of the sorted nodes the least number of first bits that at most ``window`` others share; BITS + 1 where none is enough.

    ``group`` numbers the (dim, pass) of a node, which cuts runs.  What lies before the
    first and behind the last node is unknown, so nodes there count as dense, unless
    these nodes are the ``first`` or the ``last`` of all.
    """
    n, far = len(sign), window + 1
    shared = np.full(n + far, BITS, np.int64)  # at far + j: how long nodes j and j + far agree
    if first:
        shared[:far] = -1
    if last:
        shared[n:] = -1
    if n > far:
        x = sign[far:] ^ sign[:-far]
        high, low = x >> 32, x & 0xFFFFFFFF
        agree = BITS - np.where(high > 0, np.frexp(high.astype("f8"))[1] + 32, np.frexp(low.astype("f8"))[1])
        shared[far : far + n - far] = np.where(group[far:] == group[:-far], agree, -1)
    # a run of more than window + 1 nodes around i begins at one of i - far .. i
    return 1 + np.lib.stride_tricks.sliding_window_view(shared, far + 1).max(axis=1)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors (binary, little-endian doubles of one length) as rows of length 1."""
    x = np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nodes(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(rows: key, h1, h2), the hashes null where a vector can't link; (nodes: h1, h2, node, n, dim, v)."""
    v = F.col("v")
    fine = F.col("k").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).withColumn("ok", F.coalesce(fine, F.lit(False)))
    h1, h2 = F.when(F.col("ok"), F.xxhash64("v")), F.when(F.col("ok"), F.xxhash64(F.lit(1), F.reverse("v")))
    rows = rows.withColumn("h1", h1).withColumn("h2", h2)
    nodes = rows.where("ok").groupBy("h1", "h2", "v").agg(F.min("k").alias("node"), F.count(F.lit(1)).alias("n"))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.asarray(v, "<f8").tobytes() for v in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h1", "h2", "node", "n")), pa.array([len(v) // 8 for v in x], pa.int32()), pa.array(x, pa.binary())], names=["h1", "h2", "node", "n", "dim", "v"])

    return rows.select("k", "h1", "h2"), save(nodes.mapInArrow(packed, "h1 long, h2 long, node long, n long, dim int, v binary"), "nodes")


def _pairs(nodes: DataFrame, threshold: float, window: int, miss: float) -> DataFrame:
    """Edges (a, b) that connect what is linked: passes until the measured miss of each node is small enough; nodes too dense for that are compared whole."""
    left, m, most = nodes.withColumn("missed", F.lit(0.0)), nodes.count(), max(1, WORTH // PASS_COST)
    begin, more, edges = 0, min(most, passes_for(m, threshold, window, miss)), None
    while m > 1 and more:
        both = save(_passes(left, m, range(begin, begin + more), threshold, window), "passes")
        found = both.where("b is not null").select("a", "b")
        edges = found if edges is None else edges.unionByName(found)
        gained = both.where("b is null").groupBy("a", "pass").agg(F.max("gain").alias("gain")).groupBy("a").agg(F.sum("gain").alias("gain"))  # vectors may share an id
        rest = left.join(gained.withColumnRenamed("a", "node"), "node").withColumn("missed", F.col("missed") + F.col("gain")).where(F.col("missed") > math.log(miss))
        left = save(rest.drop("gain").select(*left.columns), "dense")
        begin += more
        # nodes that are done within the passes they may take, at the rate they measured; the others stay, as pairs with them count too
        able = F.col("missed") <= begin / most * math.log(miss)
        m, soon, gain = left.agg(F.count(F.lit(1)), F.count(F.when(able, 1)), F.sum(F.when(able, F.col("missed")))).first()
        more = min(most - begin, max(begin, math.ceil(begin * (soon * math.log(miss) / gain - 1)))) if soon else 0  # few rounds
    whole = _whole(left, m, threshold) if m > 1 else None
    if edges is None:
        return whole if whole is not None else nodes.where("false").select(F.col("node").alias("a"), F.col("node").alias("b"))
    return edges if whole is None else edges.unionByName(whole)


def _whole(left: DataFrame, m: int, threshold: float) -> DataFrame:
    """Edges (a, b) of a forest of all links among the m nodes left, block against block."""
    blocks = math.ceil(m / REST_BLOCK)
    sent = left.withColumn("own", F.pmod(F.xxhash64("node", "h1"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "dim", "v")

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, "i", "j", "dim"):
            x, node, own = matrix(g["v"]), g["node"].to_numpy(), g["own"].to_numpy()
            one, two = np.flatnonzero(own == g["i"][0].as_py()), np.flatnonzero(own == g["j"][0].as_py())
            a, b = np.empty(0, np.int64), np.empty(0, np.int64)
            for at in range(0, len(one), 256):
                i, j = np.nonzero(x[one[at : at + 256]] @ x[two].T >= threshold)
                a, b = np.concatenate([a, node[one[at + i]]]), np.concatenate([b, node[two[j]]])
                if len(a):
                    a, b = forest(a, b)
                    a, b = a[a != b], b[a != b]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "i", "j").sortWithinPartitions("i", "j", "dim").mapInArrow(linked, "a long, b long")


def _passes(nodes: DataFrame, m: int, passes: range, threshold: float, window: int) -> DataFrame:
    """Edges (a, b, null, null), and for each pass of one of the m nodes (a, null, pass, gain): log of the probability that the pass missed a pair of it."""
    agree = _agree(threshold)
    gains = np.array([-np.inf if agree**k >= 1 else math.log1p(-(agree**k)) for k in range(BITS + 1)] + [0.0])

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                x = matrix(own.column("v"))
                for p in passes:
                    planes = np.random.default_rng([int(dim), p]).normal(size=(dim, BITS))
                    bits = (x @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([own.column("dim"), pa.array(np.full(len(x), p, "i4")), pa.array(bits), own.column("node"), own.column("v")], names=["dim", "pass", "sign", "node", "v"])

    def tagged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows under the number of their task, and the first ones also under that of the task before."""
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            copies = [(b, part, False)]
            if part and seen < window:
                copies.append((b.slice(0, window - seen), part - 1, True))
            seen += b.num_rows
            for x, at, head in copies:
                n = x.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at, "i8")), pa.array(np.full(n, head)), *(x.column(c) for c in ("dim", "pass", "sign", "node", "v"))], names=["part", "head", "dim", "pass", "sign", "node", "v"])

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[list[np.ndarray]] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "head", "dim", "pass", "sign", "node")])
                yield b

        for group in runs(_chunks(seen(), window), "chunk", "dim", "pass"):
            x, node, new = matrix(group["v"]), group["node"].to_numpy(), group["new"].to_numpy()
            found = []
            for at in range(0, len(x), 256):
                near = x[at : at + 256] @ x[at : at + 256 + window].T >= threshold
                i, j = np.nonzero(near)
                own = (j > i) & (j - i <= window) & new[np.minimum(at + j, len(x) - 1)]
                found.append((node[at + i[own]], node[at + j[own]]))
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            if len(a):
                a, b = forest(a, b)
                a, b = a[a != b], b[a != b]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.float64())], names=["a", "b", "pass", "gain"])
        if not keys:
            return
        part, head, dim, turn, sign, node = (np.concatenate([k[c] for k in keys]) for c in range(6))
        for at in np.split(np.arange(len(part)), np.flatnonzero(part[1:] != part[:-1]) + 1):
            group = np.cumsum(np.r_[0, (dim[at][1:] != dim[at][:-1]) | (turn[at][1:] != turn[at][:-1])])
            # without the head of a next task these are the last of all
            gain, own = gains[bits_needed(group, sign[at], window, part[at[0]] == 0, not head[at].any())], ~head[at]
            yield pa.RecordBatch.from_arrays([pa.array(node[at][own]), pa.nulls(int(own.sum()), pa.int64()), pa.array(turn[at][own]), pa.array(gain[own])], names=["a", "b", "pass", "gain"])

    rows = nodes.mapInArrow(keyed, "dim int, pass int, sign long, node long, v binary")
    order = ["dim", "pass", "sign", "node"]
    parts = max(1, min(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), m * len(passes) // TASK_ROWS))
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tagged, "part long, head boolean, dim int, pass int, sign long, node long, v binary")
    return spread.repartition(parts, "part").sortWithinPartitions("part", "head", *order).mapInArrow(compared, "a long, b long, pass int, gain double")


def _chunks(batches: Iterable[pa.RecordBatch], window: int, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted task in pieces that repeat the last ``window`` rows of the piece before; ``new`` marks the others.

    A head is compared with the rows before it only: nothing follows it here.
    """
    held, part, count = None, None, 0
    for b in batches:
        parts = b.column("part").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            for at in range(lo, hi, size):
                x = b.slice(at, min(size, hi - at)).select(["dim", "pass", "node", "v", "head"])
                if held is None or part != parts[at]:
                    held, part = x.slice(0, 0), parts[at]
                new = np.concatenate([np.zeros(held.num_rows, bool), np.ones(x.num_rows, bool)])
                both = pa.Table.from_batches([held, x]).combine_chunks().to_batches()[0]
                count += 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(both.num_rows, count, "i8")), *(both.column(c) for c in ("dim", "pass", "node", "v")), pa.array(new)], names=["chunk", "dim", "pass", "node", "v", "new"])
                held = both.slice(max(0, both.num_rows - window))


def _link_counts(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, links): with how many other vectors each is linked; members: component, node, n, dim, v."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = math.ceil(math.sqrt(2 * parts))  # as many pairs of blocks as tasks
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    each = F.least(F.lit(max(block, WIDEST)), F.greatest(F.lit(block), F.ceil(F.col("size") / grid)))
    cut = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / each).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sent = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "dim", "v")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, "component", "i", "j", "dim"):
            x, n, node, own = matrix(g["v"]), g["n"].to_numpy(), g["node"].to_numpy(), g["own"].to_numpy()
            one, two = np.flatnonzero(own == g["i"][0].as_py()), np.flatnonzero(own == g["j"][0].as_py())
            left, twice = np.zeros(len(x), np.int64), not np.array_equal(one, two)
            across = x[two].T
            for at in range(0, len(one), 512):
                some = one[at : at + 512]
                near = x[some] @ across >= threshold
                near &= node[some, None] != node[two]
                left[some] += near @ n[two]
                if twice:
                    left[two] += n[some] @ near
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(left)], names=["node", "links"])

    out = sent.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "dim").mapInArrow(counted, "node long, links long")
    return out.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, window: int = WINDOW, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: other vectors linked directly, the smallest id reachable, whether it is its own."""
    rows, nodes = _nodes(vectors, key, vector)
    components = save(connected_components(_pairs(nodes, threshold, window, miss)), "components")
    members = components.join(nodes.select("node", "n", "dim", "v"), "node")
    links = _link_counts(members, threshold, block)
    # nodes that share an id share its component and links
    known = nodes.select("h1", "h2", "node", "n").join(components, "node", "left").join(links, "node", "left")
    known = known.select("h1", "h2", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    out = rows.join(known, ["h1", "h2"], "left")
    component = F.coalesce("component", "k")
    return out.select(F.col("k").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("k") == component, F.lit(False)).alias("kept"))
