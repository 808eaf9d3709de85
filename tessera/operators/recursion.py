"""WITH RECURSIVE ... UNION, which drops repeats: a loop over the frontier; and results as JSON rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import _save


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 10_000) -> DataFrame:
    """All rows that seed and repeated steps over new rows give, each once.

    A round costs one anti join; rows with nulls count as equal where they agree.
    """
    seen = new = _save(seed.distinct())
    for _ in range(most_rounds):
        cols = seen.columns
        fresh = step(new).toDF(*cols).distinct()
        same = F.lit(True)
        for c in cols:
            same = same & F.col(f"f.`{c}`").eqNullSafe(F.col(f"s.`{c}`"))
        new = _save(fresh.alias("f").join(seen.alias("s"), same, "left_anti"))
        if not new.limit(1).count():
            return seen
        seen = _save(seen.unionByName(new))
    raise RecursionError(f"no end after {most_rounds} rounds")


def json_rows(df: DataFrame, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """(value): each row as a JSON object; decimals and binaries are text, JSON columns are JSON again."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name in json_columns:
            c = F.try_parse_json(c)
        elif kind.startswith("decimal"):
            c = c.cast("string")
        elif kind == "binary":
            c = F.base64(c)
        cols.append(c.alias(name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))
