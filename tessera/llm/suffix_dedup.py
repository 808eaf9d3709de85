"""Removal of repeated passages with enhanced suffix arrays and their common-prefix interval trees.

A byte goes if some string of ``length`` bytes over it also begins elsewhere.  A
suffix array of the whole corpus would need every suffix in one order; here suffixes
meet in groups that are exact all the same:

1. Anchors.  Each string of ``length`` bytes has one anchor: the window of
   ``length // 2`` bytes in it with the least hash, the leftmost of equals.  Equal
   strings have equal anchors at equal places.  Consecutive strings with the same
   anchor form a run; all that a run spans is at most 3/2 of ``length``.
2. Runs with one anchor hash are a group.  Equal runs are folded by a 128-bit hash of
   what they span, counted by partial aggregation; a run that occurs twice is repeated
   throughout.  Groups with a single kind of run need nothing more.
3. Each other group is a small text of its own: the distinct runs' spans.  Its suffix
   array (prefix doubling) with longest common prefixes is scanned with a stack for
   the nodes of the interval tree.  A node of ``length`` or more whose suffixes differ
   in the byte before them is a maximal repeat, reported with all its occurrences.
   Groups are put together to texts of ``BATCH_BYTES``.
4. A group of more than ``MOST`` distinct runs (a passage with ever new surroundings)
   would make one long text.  The places that its strings can begin at, counted from
   the anchor, are halved again and again.  A half is done where all its bytes
   together occur twice (all its strings are repeated), and dropped where the bytes
   that all its strings share occur once (none is); only what is neither is halved
   further.  Each round counts hashes by partial aggregation, so a group may have any
   number of runs, and a run sends a few rows a round.

The spans found join their documents by id; each document's spans are united and cut.

Cases: null and empty texts, and texts shorter than ``length``, stay whole; repeated
rows repeat each other and lose all their bytes; rows that share an id are told apart
by a hash of their text; ids may be null; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, lean, mix64, runs, save, text_slices

LENGTH = 400
BATCH_BYTES = 2_000_000
MOST = 1500

#: Of the hash that chooses anchors and forms groups; whether bytes are equal is told by wider hashes or by the bytes.
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        with np.errstate(over="ignore"):
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                made.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base] = made[0], made[1]
    return _POWERS[base]


def prefix_hashes(data: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2**64."""
    up, _ = _powers(base, max(len(data) + 1, 1 << 16))
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix64(data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:], dtype=np.uint64)
    return out


def span_hashes(prefix: np.ndarray, base: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes begin..end, equal for equal bytes wherever they stand."""
    _, down = _powers(base, max(len(prefix), 1 << 16))
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64))


def wide_hashes(raw: bytes, begin: list[int], end: list[int], seed: list[int]) -> np.ndarray:
    """Two rows of 64 bits: a 128-bit hash of each stretch of bytes and its seed."""
    made = [xxhash.xxh3_128_digest(raw[a:b], s) for a, b, s in zip(begin, end, seed, strict=True)]
    return np.frombuffer(b"".join(made), "<u8").reshape(-1, 2).T


def window_least(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least value in each window of w values."""
    n = len(x)
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()[:n]
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    at = np.arange(n)
    # places of those minima: from the left the first that reached it, from the right likewise the leftmost
    grid = full.ravel()
    first = np.maximum.accumulate(np.where((at % w == 0) | (x < np.concatenate([[np.uint64(0)], left[:-1]])), at, 0)).reshape(-1)
    isleast = np.where(grid[:n] == right, at, n)
    after = np.minimum.accumulate(np.concatenate([isleast, np.full(pad, n)]).reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    count = n - w + 1
    a, b = right[:count], left[w - 1 :]
    return np.where(a <= b, after[:count], first[w - 1 :])


def runs_of(data: np.ndarray, length: int) -> tuple[np.ndarray, ...] | None:
    """(anchor, first, last, key, h1, h2) of the runs of one text; None if it is too short."""
    n, k = len(data), length // 2
    if n < length:
        return None
    p1 = prefix_hashes(data, _BASE)
    at = np.arange(n - k + 1)
    grams = span_hashes(p1, _BASE, at, at + k)
    least = window_least(grams, length - k + 1)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut - 1, [len(least) - 1]])
    anchor = least[first]
    # the place of the anchor in the span is part of what makes runs equal
    raw = data.tobytes()
    h1, h2 = wide_hashes(raw, first.tolist(), (last + length).tolist(), (anchor - first).tolist())
    return anchor, first, last, grams[anchor], h1, h2


def suffix_array(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order (group, suffix), and which agree with the one before in ``length`` values.

    data: values over 0, with a 0 after each text, so that no suffix sorts into what
    another's end leaves open.  Ranks of all places double their reach until it
    covers the ``longest`` text; on the way it is ``length`` once.
    """
    n = len(data)
    rank, reach, prefix = data.astype(np.int64), 1, None
    while True:
        if reach == length:
            prefix = rank
        step = min(reach, (length if reach < length else longest) - reach)
        if step <= 0:
            break
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:]
        rank = np.unique(rank * (int(ahead.max()) + 1) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        reach += step
    order = np.lexsort((starts, rank[starts], group))
    s, g = starts[order], group[order]
    same = np.zeros(len(s), bool)
    same[1:] = (prefix[s[1:]] == prefix[s[:-1]]) & (g[1:] == g[:-1])
    return order, same


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, begin: int) -> np.ndarray:
    """Lengths of common prefixes of the suffixes at a and b, known to be ``begin`` or more, at most ``limit``."""
    got = np.minimum(limit, begin)
    live = np.flatnonzero(limit > begin)
    while len(live):
        at = got[live]
        eq = data[a[live] + at] == data[b[live] + at]
        got[live[eq]] += 1
        live = live[eq & (at + 1 < limit[live])]
    return got


def maximal_repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, before: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, indices into starts) of the interval-tree nodes of ``length`` or more that can't be extended to the left.

    before: the byte before each start, -1 where the span begins, which differs from any.
    """
    order, same = suffix_array(data, starts, group, length, int((ends - starts).max()) + 1)
    s, e, left = starts[order], ends[order], before[order]
    lcp = np.zeros(len(s), np.int64)
    at = np.flatnonzero(same)
    if not len(at):
        return
    lcp[at] = common_prefix(data, s[at - 1], s[at], np.minimum(e[at - 1] - s[at - 1], e[at] - s[at]), length)
    # differing neighbours so far: an interval is diverse if it holds a place where the byte before changes
    differ = np.zeros(len(s) + 1, np.int64)
    differ[2:] = np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (lcp > 0).astype(np.int8), [0]])))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # suffixes lo-1 .. hi-1 share length bytes
        stack: list[tuple[int, int]] = []
        for k in range(lo, hi + 1):
            size, begin = int(lcp[k]) if k < hi else 0, k - 1
            while stack and stack[-1][0] > size:
                top, begin = stack.pop()
                if differ[k] - differ[begin + 1] > 0:
                    yield top, order[begin:k]
            if size and (not stack or stack[-1][0] < size):
                stack.append((size, begin))


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            cols: list[list] = [[] for _ in range(8)]
            texts = pc.cast(b.column("text"), pa.binary()).to_pylist()
            for k, t in enumerate(texts):
                if t is None or (got := runs_of(np.frombuffer(t, np.uint8), length)) is None:
                    continue
                anchor, first, last, key, h1, h2 = got
                for c, x in zip(cols, (np.full(len(anchor), k), anchor, first, last, key.view("i8"), h1.view("i8"), h2.view("i8")), strict=False):
                    c.append(x)
            if cols[0]:
                row, anchor, first, last, key, h1, h2 = (np.concatenate(c) for c in cols[:7])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("k").take(take), b.column("th").take(take), *(pa.array(x.astype("i4")) for x in (anchor, first, last)), pa.array(key), pa.array(h1), pa.array(h2)], names=["k", "th", "anchor", "first", "last", "key", "h1", "h2"])

    return docs.mapInArrow(run, "k long, th long, anchor int, first int, last int, key long, h1 long, h2 long")


def _spans_of_runs(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (k, th, key, h1, h2, anchor, first, last, c) with the bytes that each run spans and the byte before it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            out: list[tuple] = []
            for t, rows in zip(b.column("text").to_pylist(), b.column("rows").to_pylist(), strict=True):
                data = t.encode()
                out += [(r["key"], r["h1"], r["h2"], r["c"], r["big"], r["anchor"] - r["first"], data[r["first"] : r["last"]]) for r in rows]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 4 + (pa.bool_(), pa.int32(), pa.binary()), strict=True)], names=["key", "h1", "h2", "c", "big", "into", "span"])

    # "last" is already the end of the span here
    rows = wanted.groupBy("k", "th").agg(F.collect_list(F.struct("key", "h1", "h2", "c", "big", "anchor", "first", "last")).alias("rows"))
    return docs.join(rows, ["k", "th"]).dropDuplicates(["k", "th"]).select("text", "rows").mapInArrow(run, "key long, h1 long, h2 long, c long, big boolean, into int, span binary")


def _in_groups(length: int):
    """Rows sorted by key -> (key, h1, h2, from, to): the part of each run, counted from its anchor, that is repeated."""

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(r[4]) for r in rows])
        offset = np.cumsum(sizes + 1) - sizes - 1
        data = np.zeros(sizes.sum() + len(rows) + 1, np.int16)
        data[np.arange(sizes.sum()) + np.repeat(np.arange(len(rows)), sizes)] = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).astype(np.int16) + 1
        n = sizes - length + 1
        owner = np.repeat(np.arange(len(rows)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = offset[owner] + inside
        ends = (offset + sizes)[owner]
        keys = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1][owner]
        before = np.where(inside > 0, data[starts - 1], -1)
        low = np.full(len(rows), np.iinfo(np.int32).max, np.int64)
        high = np.full(len(rows), -1, np.int64)
        for size, members in maximal_repeats(data, starts, ends, keys, before, length):
            who = owner[members]
            np.minimum.at(low, who, inside[members])
            np.maximum.at(high, who, inside[members] + size)
        own = np.flatnonzero(high >= 0)
        if len(own):
            into = np.array([r[3] for r in rows])[own]
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][c] for i in own], pa.int64()) for c in (0, 1, 2)] + [pa.array((low[own] - into).astype("i4")), pa.array((high[own] - into).astype("i4"))], names=["key", "h1", "h2", "lo", "hi"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for g in runs(batches, "key"):
            rows = list(zip(*(g[c].to_pylist() for c in ("key", "h1", "h2", "into", "span")), strict=True))
            held += rows
            size += sum(len(r[4]) for r in rows)
            if size >= BATCH_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _halves(length: int, size: int, whole: bool):
    """Rows of a round -> with a node's bytes hashed.

    A row is a run's part of a node: the places ``node * size`` and ``size - 1`` more,
    counted from ``length - length // 2`` bytes before the anchor.  u1, u2 hash all
    bytes of the run's strings that begin there (and which those are), c1, c2 the bytes
    that every string that begins in the node has.  With ``whole`` unset, rows are the
    halves of the given ones.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, h1, h2, into, span, node, done in zip(*(b.column(c).to_pylist() for c in ("key", "h1", "h2", "into", "span", "node", "done")), strict=True):
                origin = into - (length - length // 2)  # place 0, in the span
                for n in (node,) if whole else (2 * node, 2 * node + 1):
                    lo, hi = origin + n * size, origin + (n + 1) * size - 1
                    first, last = max(lo, 0), min(hi, len(span) - length)
                    if first > last:
                        continue
                    # equal only with equal places
                    u, c = (xxhash.xxh3_128_digest(span[x:y], seed) for x, y, seed in ((first, last + length, (first - origin) << 20 | (last - origin)), (hi, max(hi, lo + length), n)))
                    u1, u2, c1, c2 = np.frombuffer(u + c, "<i8").tolist()
                    out.append((key, h1, h2, into, span, n, done, first - into, last - into + length, u1, u2, c1, c2))
            if out:
                kinds = (pa.int64(),) * 3 + (pa.int32(), pa.binary(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()) + (pa.int64(),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "h1", "h2", "into", "span", "node", "done", "lo", "hi", "u1", "u2", "c1", "c2"])

    return run


def _by_halving(spans: DataFrame, length: int) -> DataFrame:
    """spans of large groups -> (key, h1, h2, lo, hi), from anchors, as from the suffix arrays."""
    schema = "key long, h1 long, h2 long, into int, span binary, node int, done boolean, lo int, hi int, u1 long, u2 long, c1 long, c2 long"
    size = 1 << (length - length // 2).bit_length()
    # a run that occurs twice is found already; it serves as a partner
    rows = spans.select("key", "h1", "h2", "into", "span", F.lit(0).alias("node"), (F.col("c") > 1).alias("done"))
    found, whole = None, True
    while size:
        now = save(rows.mapInArrow(_halves(length, size, whole), schema), "halves")
        shared = now.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min("done").alias("all_done")).where("n > 1 and not all_done").select("c1", "c2")
        live = now.join(shared, ["c1", "c2"], "left_semi")
        same = live.groupBy("u1", "u2").agg(F.count(F.lit(1)).alias("n"), F.min("done").alias("all_done"), F.min(F.struct("key", "h1", "h2", "into", "span", "node")).alias("one"))
        same = save(same, "same")
        hit = live.where("not done").join(same.where("n > 1").select("u1", "u2"), ["u1", "u2"], "left_semi").select("key", "h1", "h2", "lo", "hi")
        hit = save(hit, "hit")
        found = hit if found is None else found.unionByName(hit)
        rows = same.select("one.*", (F.col("all_done") | (F.col("n") > 1)).alias("done"))
        size, whole = size // 2, False
    return found


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (k, th, text) -> (k, th, lo, hi): byte spans that strings found elsewhere cover; they may overlap."""
    lean(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchored = save(_anchored(docs, length), "anchors")
    kinds = anchored.groupBy("key", "h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k", "th", "anchor", "first", (F.col("last") + length).alias("last"))).alias("one"))
    kinds = save(kinds, "kinds")
    groups = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("all")).where("all > 1")
    groups = save(groups, "groups")
    # runs that occur twice: repeated throughout, counted from the anchor
    twice = kinds.where("c > 1").select("key", "h1", "h2", (F.col("one.first") - F.col("one.anchor")).alias("lo"), (F.col("one.last") - F.col("one.anchor")).alias("hi"))
    wanted = kinds.join(groups.where("kinds > 1").select("key", (F.col("kinds") > MOST).alias("big")), "key").select("key", "h1", "h2", "c", "big", "one.*")
    spans = save(_spans_of_runs(docs, wanted), "spans")
    small = spans.where("not big").repartition(parts, "key").sortWithinPartitions("key", "h1", "h2").mapInArrow(_in_groups(length), "key long, h1 long, h2 long, lo int, hi int")
    found = twice.unionByName(small)
    if groups.where(F.col("kinds") > MOST).limit(1).count():
        hit = _by_halving(spans.where("big"), length)
        found = found.unionByName(hit)
    found = save(found.groupBy("key", "h1", "h2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "found")
    out = anchored.join(found, ["key", "h1", "h2"]).select("k", "th", (F.col("anchor") + F.col("lo")).alias("lo"), (F.col("anchor") + F.col("hi")).alias("hi"))
    discard(kinds, groups)
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row, and with keep_text also spans and the bytes kept."""
    docs = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))
    own = docs.withColumn("k", F.coalesce("k", F.lit(-(2**63))))  # the hash of the text tells rows apart
    spans = repeated_spans(own, length).groupBy("k", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            out = []
            spans_of = b.column("spans")
            for k, t in enumerate(b.column("text").to_pylist()):
                data, kept, merged = (t or "").encode(), [], []
                if spans_of[k].is_valid:
                    at = spans_of.offsets[k].as_py(), spans_of.offsets[k + 1].as_py()
                    x = spans_of.values.slice(at[0], at[1] - at[0])
                    lo, hi = x.field("lo").to_numpy(), x.field("hi").to_numpy()
                    order = np.argsort(lo, kind="stable")
                    lo, reach = lo[order], np.maximum.accumulate(hi[order])
                    new = np.concatenate([[True], lo[1:] > reach[:-1]])
                    merged = list(zip(lo[new].tolist(), reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])].tolist(), strict=True))
                end = 0
                for lo_, hi_ in merged:
                    kept.append(data[end:lo_])
                    end = hi_
                kept = b"".join([*kept, data[end:]])
                out.append((len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), *((merged, kept) if keep_text else ())))
            cols = list(zip(*out, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3])]
            names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                arrays += [pa.array([[{"lo": a, "hi": z} for a, z in m] for m in cols[4]], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(cols[5], pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays([b.column("k"), *arrays], names=names)

    schema = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<lo:long,hi:long>>, kept binary" if keep_text else "")
    joined = own.join(spans, ["k", "th"], "left").select("k", "text", "spans")
    return joined.mapInArrow(cut, schema).withColumn("k", F.when(F.col("k") != -(2**63), F.col("k"))).withColumnRenamed("k", key)
