"""An optional check that a query is served by keys and indexes: on demand, never on by default.

It looks at the physical plan: a scan is served if a filter on the first column of a
key or index reaches it.  An unfiltered read is allowed up to a number of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

CAP = 100


class NoIndex(ValueError):
    pass


def scans(df: DataFrame) -> list[tuple[str, set[str]]]:
    """(location, columns whose comparisons reached the scan) of each file scan of the plan."""
    made = df._jdf.queryExecution()
    leaves = made.optimizedPlan().collectLeaves()
    places = []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and "HadoopFsRelation" in leaf.relation().getClass().getSimpleName():
            places.append(leaf.relation().location().rootPaths().mkString(","))
    pushed = re.findall(r"FileScan parquet[^\n]*?PushedFilters: \[([^\n]*?)\], ReadSchema", made.executedPlan().toString())
    column = re.compile(r"(?:EqualTo|EqualNullSafe|In|GreaterThan\w*|LessThan\w*)\(`?([^,`()]+)`?,")
    return [(place, set(column.findall(p))) for place, p in zip(places, pushed, strict=False)]


def sorts(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return bool(re.search(r"^\W*Sort ", plan, re.M))


def check(df: DataFrame, indexes: dict[str, list[list[str]]], cap: int = CAP) -> DataFrame:
    """df, or NoIndex naming what to create.  indexes: table -> its key and index columns; a table is known by its folder's name.

    Without any filter, sort, join or aggregation, df is cut to ``cap`` rows.
    """
    found = scans(df)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    plain = len(found) == 1 and not re.search(r"Filter|Sort|Join|Aggregate|Window|Distinct", plan)
    if plain:
        return df.limit(cap)
    for location, columns in found:
        table = next((t for t in indexes if re.search(rf"/{re.escape(t)}(?:\.parquet|/|$|,)", location)), None)
        if table is None:
            continue
        if not any(cols and cols[0] in columns for cols in indexes[table]):
            wanted = sorted(columns)[0] if columns else None
            raise NoIndex(f"NO_INDEX: {table} is read whole" + (f"; CREATE INDEX {table}_{wanted} ON {table}({wanted})" if wanted else "; filter by " + ", ".join(indexes[table][0])))
    if sorts(df) and not found:
        raise NoIndex("NO_INDEX: a sort over no indexed table")
    return df
