"""Sessions: configuration, functions, views over a folder of tables, and the dialect's front door."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tessera import dialect
from tessera.functions import json_fns

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def build(master: str = "local[*]", app: str = "tessera", **conf) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares.  Where none is named, a temporary one if this machine is all there is, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_registered: set[int] = set()


def prepare(spark: SparkSession) -> SparkSession:
    # Compiled full outer merge joins keep all pairs of a key in memory before they hand on one; the plain ones keep its rows.
    spark.conf.set("spark.sql.codegen.join.fullOuterSortMergeJoin.enabled", "false")
    if id(spark) not in _registered:
        json_fns.register(spark)
        _registered.add(id(spark))
    return spark


class Engine:
    """SQL in the dialect over tables of a folder, or over any registered frames."""

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: Iterable[str] = TABLES, prefix: str = ""):
        self.spark, self.nulls, self.prefix = prepare(spark), None, prefix
        if folder:
            for t in tables:
                self.register(t, spark.read.parquet(f"{folder}/{t}.parquet"))

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(self.prefix + name)

    def set_null_order(self, order: str | None) -> None:
        """``first`` or ``last`` for both directions; None: NULL is the largest value."""
        if order not in (None, "first", "last"):
            raise ValueError("the null order is first, last or None")
        self.nulls = order

    def sql(self, text: str, params: list | None = None) -> DataFrame:
        made, args = dialect.bind(text, params, self.nulls)
        return self.spark.sql(made, args=args) if args else self.spark.sql(made)
