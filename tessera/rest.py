"""A query string over a table: select, filters, order, limit and offset become one lazy frame."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.types import parameter

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
_OPS = {"eq": "__eq__", "neq": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def column(text: str) -> Column:
    """A column, or one level into its JSON text: ``col->>key``."""
    name, arrow, key = text.partition("->>")
    if not _NAME.match(name) or arrow and not _NAME.match(key):
        raise ValueError(f"not a column: {text!r}")
    return F.get_json_object(F.col(name), f"$['{key}']").alias(key) if arrow else F.col(name)


@dataclass
class Filter:
    column: str
    op: str
    operand: str
    negated: bool = False

    def condition(self) -> Column:
        c = column(self.column)
        if self.op in _OPS:
            one = getattr(c, _OPS[self.op])(F.lit(parameter(self.operand)))
        elif self.op in ("like", "ilike"):
            one = getattr(c, self.op)(self.operand)
        elif self.op == "in":
            if not (self.operand.startswith("(") and self.operand.endswith(")")):
                raise ValueError("in takes (a,b,c)")
            one = c.isin([parameter(x) for x in self.operand[1:-1].split(",")])
        elif self.op == "is":
            if self.operand not in ("null", "true", "false"):
                raise ValueError("is takes null, true or false")
            one = c.isNull() if self.operand == "null" else c.eqNullSafe(F.lit(self.operand == "true"))
        else:
            raise ValueError(f"no such operator: {self.op}")
        return ~one if self.negated else one


@dataclass
class Query:
    select: list[str] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0

    @classmethod
    def parse(cls, text: str) -> Query:
        q = cls()
        for piece in text.split("&") if text else []:
            key, eq, value = piece.partition("=")
            if not eq:
                raise ValueError(f"no value: {piece!r}")
            if key == "select":
                q.select = [x.strip() for x in value.split(",") if x.strip() != "*"]
            elif key == "order":
                for x in value.split(","):
                    name, _, way = x.rpartition(".")
                    q.order.append((name, way == "desc") if name and way in ("asc", "desc") else (x, False))
            elif key in ("limit", "offset"):
                if not value.isdigit():
                    raise ValueError(f"{key} is a whole number")
                setattr(q, key, int(value))
            else:
                negated = value.startswith("not.")
                op, dot, operand = value.removeprefix("not.").partition(".")
                if not dot:
                    raise ValueError(f"no operator: {piece!r}")
                q.filters.append(Filter(key, op, operand, negated))
        return q

    def matching(self, df: DataFrame) -> DataFrame:
        for f in self.filters:
            df = df.where(f.condition())
        return df

    def run(self, df: DataFrame) -> DataFrame:
        df = self.matching(df)
        if self.order:
            df = df.orderBy(*[column(n).desc_nulls_first() if desc else column(n).asc_nulls_last() for n, desc in self.order])
        df = df.offset(self.offset) if self.offset else df
        df = df.limit(self.limit) if self.limit is not None else df
        return df.select(*map(column, self.select)) if self.select else df

    def total(self, df: DataFrame) -> DataFrame:
        """The exact count of the same filters, without order and limit."""
        return self.matching(df).agg(F.count(F.lit(1)).alias("total"))


def check_mutation(query: Query) -> None:
    if not query.filters:
        raise ValueError("an update or delete needs a filter")
