"""HyperLogLog registers as plain aggregation: mergeable, and the same in any engine that can hash.

A register is the largest rank of a bucket, so sketches are rows (bucket, rank) and
merging is a maximum; 2**P rows at most for each key, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = 14


def registers(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """(keys, bucket, rank)"""
    h = F.xxhash64(value.cast("string"))
    rest = F.shiftleft(h, P)
    # leading zeros of the rest, plus 1; 51 for none
    rank = F.when(rest == 0, F.lit(64 - P + 1)).otherwise(F.lit(64) - F.length(F.bin(rest)) + 1)
    return df.where(value.isNotNull()).groupBy(*keys, F.shiftrightunsigned(h, 64 - P).cast("int").alias("bucket")).agg(F.max(rank).cast("int").alias("rank"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys, "bucket").agg(F.max("rank").alias("rank"))


def estimate(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, distinct): linear counting below 2.5 m."""
    m = 1 << P
    alpha = 0.7213 / (1 + 1.079 / m)
    s = sketches.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("_s"))
    raw = alpha * m * m / (F.col("_s") + (m - F.col("_n")))
    linear = F.when(F.col("_n") < m, m * F.log(m / (m - F.col("_n"))))
    out = F.when((raw <= 2.5 * m) & linear.isNotNull(), linear).otherwise(raw)
    return s.select(*keys, F.round(out).cast("long").alias("distinct"))
