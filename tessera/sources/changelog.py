"""Change logs: what was written and is not sealed yet, and how it joins the sealed snapshot.

A log is a frame (seq, op, key columns, other columns); op is 'upsert' or 'delete'.
The last entry of a key wins.  Merging removes from the snapshot the keys that the
collapsed log touches and adds its upserts; keys are never null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPSERT, DELETE = "upsert", "delete"


def append(log: DataFrame | None, rows: DataFrame, op: str, first_seq: int | None = None) -> DataFrame:
    """rows as log entries after those of log, in no particular order among themselves."""
    if first_seq is None:
        first_seq = (log.agg(F.max("seq")).first()[0] or 0) + 1 if log is not None else 1
    new = rows.withColumn("op", F.lit(op)).withColumn("seq", F.monotonically_increasing_id() + F.lit(first_seq))
    return new if log is None else log.unionByName(new, allowMissingColumns=True)


def collapse(log: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: its last entry, by one partial aggregation."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def merge(snapshot: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows.  Columns follow the snapshot; those the log lacks are null in its rows, new ones come last."""
    last = collapse(log, keys)
    # an anti join on the keys alone; the optimiser broadcasts the log where it is small
    kept = snapshot.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.where(F.col("op") == UPSERT).drop("op", "seq"), allowMissingColumns=True)


def lookup(snapshot: DataFrame, log: DataFrame, **key) -> DataFrame:
    """The current row of one key: the filter reaches both scans before they meet."""
    cond = [F.col(k) == v for k, v in key.items()]
    for c in cond:
        snapshot, log = snapshot.where(c), log.where(c)
    return merge(snapshot, log, list(key))
