"""Registered queries over the driver's tables and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import relational, shapes, stored, wider

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = relational.QUERIES | shapes.QUERIES | stored.QUERIES | wider.QUERIES
ORACLE_SQL: dict[str, str] = relational.ORACLE_SQL | shapes.ORACLE_SQL | stored.ORACLE_SQL | wider.ORACLE_SQL
