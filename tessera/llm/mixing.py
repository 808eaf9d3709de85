"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are counts of words.  The sources, ordered by code point with null last, weigh
in turn 1, 2, 3; all targets add up to all sizes, but no source gets more than
``most`` times its own size, and what is over goes to the others by weight until none
is above.  A source then takes all its documents as often as its target allows, and
for the budget that remains its documents are counted by exact length: of each length
the proportional share is taken, and bounded-knapsack dynamic programming over the
lengths left closes the gap.  Which documents of a length are taken is decided by a
seeded hash of their id, so that reruns agree.

Scale: words are counted in one pass; only (id, source, size, hash) moves on.  A
source's plan is made from its histogram of lengths, never from its documents.  The
documents of one length are numbered within buckets of their hash, so a length that
holds a third of all rows is numbered by as many tasks as others.

Cases: null or empty texts have size 0, stay in the result and are never taken; a
null source is a source of its own; repeated rows are mixed each, those with the same
id and size are interchangeable; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, save

WEIGHTS = (1, 2, 3)
SEED = 42
#: Buckets of the hash in which the documents of one (source, length) are numbered.
BUCKETS = 1024
#: Words that the table of sums decides about, or four times the longest text; what a source needs above is shared out by length beforehand.
MAX_CELLS = 200_000


def room_for(lengths: np.ndarray) -> int:
    """Words that the table decides about, so many that half of them hold any document: none is passed over for its length."""
    return max(MAX_CELLS, 4 * int(lengths.max(initial=0)))


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exact_fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that the sum comes nearest to budget without passing it.

    Counts are split in powers of two, each a 0/1 item; ``made_by`` remembers the item
    that first reached a sum, which suffices to walk back.
    """
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not len(lengths):
        return taken
    order, room = np.random.default_rng(SEED).permutation(len(lengths)), room_for(lengths)
    for k in order:  # narrows a gap that the table should not hold
        if budget <= room:
            break
        n = min(counts[k], max(0, budget - room // 2) // lengths[k])
        taken[k] += n
        budget -= int(n * lengths[k])
    if budget > room:  # only if all documents are taken
        return taken
    made_by = np.full(budget + 1, -1, np.int32)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    items: list[tuple[int, int, int]] = []
    for k in order:
        length, left, part = int(lengths[k]), int(counts[k] - taken[k]), 1
        left = min(left, budget // length if length else 0)
        while left > 0:
            part = min(part, left)
            w = part * length
            if w <= budget:
                new = reached[: budget + 1 - w] & ~reached[w:]
                at = np.flatnonzero(new) + w
                made_by[at] = len(items)
                reached[at] = True
                items.append((int(k), part, w))
            left -= part
            part *= 2
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        k, part, w = items[made_by[at]]
        taken[k] += part
        at -= w
    return taken


def plan_source(sizes: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """Whole rounds over a source, and how many documents of each size come once more."""
    total = int((sizes * counts).sum())
    more = np.zeros(len(sizes), np.int64)
    if not total:
        return 0, more
    budget = int(round(target))
    rounds = min(budget // total, int(target // total) if target >= 0 else 0)
    budget -= rounds * total
    if budget <= 0:
        return rounds, more
    live = sizes > 0
    more[live] = (counts[live].astype(object) * max(0, budget - room_for(sizes[live])) // total).astype(np.int64)
    gap = budget - int((more * sizes).sum())
    rest = np.where(live, counts - more, 0)
    use = rest > 0
    more[use] += exact_fill(sizes[use], rest[use], gap)
    return rounds, more


def targets(sizes: DataFrame, most: float, weights: tuple[float, ...]) -> DataFrame:
    """sizes (source, source_size) with target; one row for each source, ranked without gathering them in one task."""
    # rank by order of source: numbers within ranges, plus the rows of the ranges before (one row for each range)
    key = [F.col("source").isNull(), "source"]
    parts = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = save(sizes.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "sources")
    ranges = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_before") + F.col("_at"), F.lit(len(weights))).cast("int"))
    w = save(numbered.join(F.broadcast(ranges), "_part").select("source", "source_size", weight.alias("weight")), "weights")
    everything = w.agg(F.sum("source_size").cast("double")).first()[0] or 0.0
    # the common price of a unit of weight: rises as sources reach their most, one small aggregation a time
    price, full = None, F.lit(False)
    while True:
        kept, weighed, n = w.agg(F.sum(F.when(full, F.col("source_size") * most)), F.sum(F.when(~full, F.col("weight"))), F.sum(full.cast("int"))).first()
        if not weighed:
            break
        new = (everything - (kept or 0.0)) / weighed
        if price is not None and n == before:
            break
        price, before = new, n
        full = F.col("weight") * price >= F.col("source_size") * most
    target = F.least(F.col("weight") * (price or 0.0), F.col("source_size") * most)
    out = save(w.select("source", "source_size", target.alias("target")), "targets")
    discard(numbered, w)
    return out


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: float = 3.0, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED, beside: tuple[str, ...] = ()) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken): how often the mix has each document, and so many words; then the columns ``beside`` of its row."""
    h = F.when(F.col(key).isNull(), F.xxhash64(F.lit(seed), F.col(text))).otherwise(F.xxhash64(F.lit(seed), F.col(key)))
    lite = save(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), h.alias("h"), *beside), "sizes")
    hist = save(lite.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    goals = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), most, weights)

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rounds, more = plan_source(rows["size"].to_numpy(), rows["n"].to_numpy(), float(rows["target"].iloc[0]))
        return rows.assign(rounds=rounds, more=more)[["source", "size", "source_size", "target", "rounds", "more"]]

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    planned = hist.alias("a").join(goals.alias("b"), same({"source": F.col("a.source")}, {"source": F.col("b.source")})).select("a.source", "size", "n", "source_size", "target")
    plans = save(planned.groupBy("source").applyInPandas(plan, "source string, size long, source_size long, target double, rounds long, more long"), "plans")
    # the documents of a length in the order of (bucket, hash, key): numbers within a bucket, plus the buckets before it
    lite = lite.withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKETS.bit_length() + 1).cast("int"))
    cells = lite.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = cells.select("source", "size", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    allowed = before.alias("a").join(plans.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))).select("a.source", "a.size", "bucket", (F.col("more") - F.col("before")).alias("room"), "source_size", "target", "rounds")
    at = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "key", *beside))
    numbered = lite.withColumn("at", at)
    out = numbered.alias("a").join(allowed.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.bucket") == F.col("b.bucket")))
    copies = F.when(F.col("a.size") > 0, F.col("rounds") + F.when(F.col("at") <= F.col("room"), 1).otherwise(0)).otherwise(0).cast("long")
    return out.select(F.col("key").alias(key), F.col("a.source").alias("source"), F.col("a.size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("a.size")).alias("taken"), *beside)

