"""Collections with writes: documents in a keyed table, changes through its log, indexes as metadata and checks."""

from __future__ import annotations

import json
import secrets
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import collections as docs
from tessera.sources.table_store import Table, TableStore, UniqueViolation


class Collection:
    def __init__(self, store: TableStore, name: str):
        self.spark = store.spark
        self.table: Table = store.create(name, {"_id": "TEXT", "doc": "JSON"}, ["_id"], if_not_exists=True)
        self.indexes: dict[str, dict] = {}

    @property
    def df(self) -> DataFrame:
        return self.table.read()

    def insert(self, documents: list[dict]) -> list[str]:
        rows = []
        for d in documents:
            own = d.get("_id", f"{int(time.time()):08x}{secrets.token_hex(8)}")
            rows.append((own if isinstance(own, str) else json.dumps(own), json.dumps({k: v for k, v in d.items() if k != "_id"})))
        new = self.spark.createDataFrame(rows, "_id string, doc string")
        self._unique(self.df.unionByName(new))
        self.table.insert(new)
        return [r[0] for r in rows]

    def find(self, query: dict | None = None, **options) -> DataFrame:
        return docs.find(self.df, query, **options)

    def count(self, query: dict | None = None) -> int:
        return docs.count(self.df, query)

    def aggregate(self, stages: list[dict], others: dict[str, Collection] | None = None) -> DataFrame:
        return docs.pipeline(self.df, stages, {n: c.df for n, c in (others or {}).items()})

    def update(self, query: dict, change: dict, multi: bool = False, upsert: bool = False) -> int:
        new = docs.update(self.df, query, change, multi)
        n = self.table.insert(new, upsert=True)
        if not n and upsert:
            self.insert([docs.updated({}, change)])
            return 1
        return n

    def delete(self, query: dict, multi: bool = False) -> int:
        hit = self.find(query).select("_id")
        ids = [r["_id"] for r in hit.orderBy("_id").limit(1).collect()] if not multi else None
        if multi:
            gone = self.df.join(hit, "_id", "left_semi")
            return self.table._append(gone, "delete")
        return self.table.delete(F.col("_id").isin(ids)) if ids else 0

    def create_index(self, name: str, fields: list[str], unique: bool = False, expire_after: int | None = None) -> None:
        self.indexes[name] = {"fields": fields, "unique": unique, "expire_after": expire_after}
        try:
            self._unique(self.df)
        except UniqueViolation:
            del self.indexes[name]
            raise

    def _unique(self, df: DataFrame) -> None:
        get = docs.Fields(nested=True)
        for name, ix in self.indexes.items():
            if ix["unique"]:
                keys = [get(f).alias(f"k{i}") for i, f in enumerate(ix["fields"])]
                known = df.select(*keys).na.drop()
                if known.groupBy(*known.columns).count().where("count > 1").limit(1).count():
                    raise UniqueViolation(f"UNIQUE_VIOLATION: {name}")

    def sweep(self, now: float | None = None) -> int:
        """Deletes what its time-to-live indexes say."""
        gone = 0
        for ix in self.indexes.values():
            if ix["expire_after"] is not None:
                gone += self.table._append(docs.expired(self.df, ix["fields"][0], ix["expire_after"], time.time() if now is None else now), "delete")
        return gone
