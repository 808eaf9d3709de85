"""Transactions over a table store: changes are buffered, read back through the transaction, and published together.

A transaction holds on to each table's manifest of its first touch, and reads that.  To
commit, it writes a log folder and a manifest for each table it changed, all marked with
its id, and then one file that says that the id is committed: only from there do
readers see any of it.  A writer that meets an unfinished transaction aborts it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import changelog
from tessera.sources.table_store import Conflict, Table, TableStore


class Transaction:
    """Reads see the tables as they were at their first touch, plus the transaction's own changes."""

    def __init__(self, store: TableStore):
        self.store, self.seen, self.changes, self.open = store, {}, {}, True

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.open:
            self.rollback() if kind else self.commit()

    def _table(self, name: str) -> Table:
        if not self.open:
            raise RuntimeError("the transaction is over")
        t = self.store.table(name)
        if name not in self.seen:
            self.seen[name] = t._settled()
        return t

    def read(self, name: str) -> DataFrame:
        t = self._table(name)
        df = t.read(m=self.seen[name])
        for k, (op, rows) in enumerate(self.changes.get(name, [])):
            df = changelog.merge(df, rows.withColumn("op", F.lit(op)).withColumn("seq", F.lit(k).cast("long")), t.keys)
        return df

    def insert(self, name: str, rows: DataFrame) -> None:
        t = self._table(name)
        rows = t._conform(rows)
        t._check(rows, self.read(name))
        self.changes.setdefault(name, []).append((changelog.UPSERT, rows))

    def update(self, name: str, assignments: dict[str, str], where: str | None = None) -> None:
        t = self._table(name)
        if set(assignments) & set(t.keys):
            raise ValueError("a key column can't be updated")
        rows = self.read(name).where(where) if where else self.read(name)
        new = t._conform(rows.withColumns({c: F.expr(v) for c, v in assignments.items()}))
        t._required(new)
        self.changes.setdefault(name, []).append((changelog.UPSERT, new))
        for index, cols in t.manifest["unique"].items():
            if set(cols) & set(assignments):
                try:
                    t._distinct(index, cols, self.read(name))
                except ValueError:
                    self.changes[name].pop()
                    raise

    def delete(self, name: str, where: str | None = None) -> None:
        self._table(name)
        rows = self.read(name).where(where) if where else self.read(name)
        self.changes.setdefault(name, []).append((changelog.DELETE, rows))

    def commit(self) -> dict[str, int]:
        """Rows changed a table; another writer's commit since the first touch is a Conflict, and nothing is changed."""
        for name, m in self.seen.items():
            if self.store.table(name).manifest["number"] != m["number"]:
                raise Conflict(name)
        self.open, tx, done, staged = False, uuid.uuid4().hex, {}, []
        for name, changes in self.changes.items():
            t, net = self.store.table(name), None
            for k, (op, rows) in enumerate(changes):
                one = t._conform(rows).withColumn("op", F.lit(op)).withColumn("seq", F.lit(k).cast("long"))
                net = one if net is None else net.unionByName(one)
            done[name], new = t._stage(changelog.collapse(net, t.keys).drop("seq"), self.seen[name], tx)
            if done[name]:
                staged.append((t, new))
        try:
            for t, new in staged:
                t._publish(new)  # not seen by readers yet
        except Conflict:
            self.store.settle(tx, "aborted")
            raise
        if staged and self.store.settle(tx, "committed") != "committed":
            raise Conflict(", ".join(t.name for t, _ in staged))
        return done

    def rollback(self) -> None:
        self.changes, self.open = {}, False
