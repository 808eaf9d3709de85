"""Directed, weighted, typed edges (src, dst, type, weight): upserts, neighbours, reachability, widest paths.

Traversals are loops of joins on the frontier; their state is written to the shared
folder every round, so lineage stays short and lost executors cost one round.  Arcs are
dealt out once, and stay in place: what a round sends grows with what it changes.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import shared_dir

IDENTITY = ["src", "dst", "type"]
#: Arcs in one partition of those that stay in place, about.
ARCS = 1 << 18


def _save(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mutate(edges: DataFrame, upserts: DataFrame | None = None, deletes: DataFrame | None = None, merge: str = "set") -> DataFrame:
    """Edges after a batch: upserts, then deletes.  Upserts have a column seq if their order matters; merge is set or max."""
    if upserts is not None:
        order = F.col("seq") if "seq" in upserts.columns else F.lit(1)
        new = upserts.select(*IDENTITY, "weight", order.cast("long").alias("seq"))
        both = edges.select(*IDENTITY, "weight", F.lit(-1).cast("long").alias("seq")).unionByName(new)
        pick = F.max("weight") if merge == "max" else F.max_by("weight", F.struct("seq", "weight"))
        edges = both.groupBy(*IDENTITY).agg(pick.alias("weight"))
    if deletes is not None:
        edges = edges.join(deletes.select(*IDENTITY), IDENTITY, "left_anti")
    return edges.select(*IDENTITY, "weight")


def changed(before: DataFrame, after: DataFrame) -> int:
    """How many edges a batch made, altered or removed."""
    return before.select(*IDENTITY, "weight").exceptAll(after.select(*IDENTITY, "weight")).select(*IDENTITY).union(after.select(*IDENTITY, "weight").exceptAll(before.select(*IDENTITY, "weight")).select(*IDENTITY)).distinct().count()


def neighbours(edges: DataFrame, node: str, direction: str = "out", floor: int | None = None) -> DataFrame:
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    found = edges.where(F.col(here) == node)
    found = found if floor is None else found.where(F.col("weight") >= floor)
    return found.select(F.col(there).alias("node"), "weight", "type").orderBy("node", "type")


def _arcs(edges: DataFrame, directed: bool) -> tuple[DataFrame, int]:
    """Arcs by src, dealt out and sorted on the executors' disks, and their partitions; what is lost is made again from saved edges.

    To be released.  A frontier that is dealt out alike meets them where they are.
    """
    one = _save(edges)
    rows = one.count()
    if not directed:
        one, rows = one.unionByName(one.toDF("dst", "src", *one.columns[2:])), 2 * rows
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-rows // ARCS))
    return one.repartition(parts, "src").sortWithinPartitions("src").persist(StorageLevel.DISK_ONLY), parts


def reachable(edges: DataFrame, seeds: DataFrame, floor: int | None = None, directed: bool = True) -> DataFrame:
    """(node): the seeds, known or not, and all that edges of weight >= floor lead to."""
    arcs, parts = _arcs((edges if floor is None else edges.where(F.col("weight") >= floor)).select("src", "dst"), directed)
    seen = frontier = _save(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct())
    while True:
        new = arcs.join(frontier.repartition(parts, "node"), F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = _save(new.join(seen, "node", "left_anti"))
        if not frontier.limit(1).count():
            arcs.unpersist()
            return seen
        seen = seen.unionByName(frontier)


def widest(edges: DataFrame, source: str, directed: bool = True) -> DataFrame:
    """(node, bottleneck) of all nodes that source reaches: the largest least weight of a path; null for source itself."""
    arcs, parts = _arcs(edges.select("src", "dst", "weight"), directed)
    top = F.lit(float("inf") if arcs.schema["weight"].dataType.typeName() in ("float", "double") else 2**63 - 1)
    best = _save(edges.sparkSession.range(1).select(F.lit(source).alias("node"), top.alias("w"), F.lit(True).alias("new")))
    while True:
        frontier = best.where("new").select("node", "w").repartition(parts, "node")
        step = arcs.join(frontier, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), F.least("weight", "w").alias("w")).where(F.col("node") != source)
        both = step.unionByName(best.select("node", F.col("w").alias("known")), allowMissingColumns=True)
        both = both.groupBy("node").agg(F.max("w").alias("w"), F.max("known").alias("known"))
        best = _save(both.select("node", F.greatest("w", "known").alias("w"), F.expr("w is not null and (known is null or w > known)").alias("new")))
        if not best.where("new").limit(1).count():
            arcs.unpersist()
            return best.select("node", F.when(F.col("w") < top, F.col("w")).alias("bottleneck"))


def widest_path(edges: DataFrame, source: str, target: str, directed: bool = True) -> tuple[bool, int | None]:
    """(connected, bottleneck); a node is connected to itself without a bottleneck."""
    if source == target:
        return True, None
    row = widest(edges, source, directed).where(F.col("node") == target).first()
    return (True, row["bottleneck"]) if row else (False, None)
