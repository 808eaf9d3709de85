"""Tables with a primary key: declared schema, unsealed log, sealed snapshots, and numbered manifests.

A table is a folder: ``snapshot-N`` folders of Parquet sorted by key, ``log`` folders of
append-only Parquet of (seq, op, columns), and ``manifest-N.json`` files naming the
schema, the live snapshot, the sequence number it is sealed to, and the log folders that
are committed.  Manifests are never replaced: the next number is created, which only one
writer can, and the newest whole one holds.  So a writer that dies leaves the table as
it was, what it wrote is never read, and of two writers at once one gets a ``Conflict``.
A log folder may wait for its transaction: it counts once ``_transactions`` under the
store says that the transaction is committed (see transactions.py).  Everything goes
through Hadoop's file system, so folders may be anywhere.
"""

from __future__ import annotations

import contextlib
import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import types
from tessera.sources import changelog

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


#: Manifests kept besides the newest, and milliseconds after which a manifest that was begun and not ended is passed over.
KEPT, LEASE_MS = 8, 60_000


class UniqueViolation(ValueError):
    pass


class Conflict(RuntimeError):
    """Another writer was first; nothing was changed."""


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def create_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """Writes a small file unless there is one; whether it did."""
    from py4j.protocol import Py4JJavaError

    fs, at = file_system(spark, path)
    try:
        stream = fs.create(at, False)
    except Py4JJavaError:
        if fs.exists(at):
            return False
        raise
    stream.write(bytearray(data))
    stream.close()
    return True


def read_small(spark: SparkSession, path: str) -> bytes | None:
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


class Table:
    def __init__(self, store: TableStore, name: str):
        self.store, self.name, self.spark = store, name, store.spark
        self.path = f"{store.folder}/{name}"

    # -- manifest
    def _file(self, leaf: str):
        return file_system(self.spark, f"{self.path}/{leaf}")

    def _numbers(self) -> list[tuple[int, int]]:
        """(number, time of change) of the manifests, newest first."""
        fs, at = file_system(self.spark, self.path)
        if not fs.exists(at):
            return []
        found = [(x.getPath().getName(), x.getModificationTime()) for x in fs.listStatus(at)]
        return sorted(((int(m[1]), t) for n, t in found if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), reverse=True)

    def _newest(self) -> dict | None:
        for n, _ in self._numbers():
            with contextlib.suppress(ValueError):  # begun and not ended
                return json.loads(read_small(self.spark, f"{self.path}/manifest-{n:012d}.json") or b"") | {"number": n}
        return None

    @property
    def manifest(self) -> dict:
        if (m := self._newest()) is None:
            raise KeyError(self.name)
        return m

    def _publish(self, manifest: dict) -> None:
        """The manifest after number ``manifest["number"]``; a Conflict if there is one already."""
        numbers = self._numbers()
        top, changed = numbers[0] if numbers else (0, 0)
        base = manifest.get("number", 0)
        if top != base and (self._newest() or {"number": 0})["number"] != base:
            raise Conflict(self.name)
        if top != base and time.time() * 1000 - changed < LEASE_MS:
            raise Conflict(self.name)  # another writer is at it
        body = {k: v for k, v in manifest.items() if k != "number"}
        if not create_once(self.spark, f"{self.path}/manifest-{top + 1:012d}.json", json.dumps(body).encode()):
            raise Conflict(self.name)
        manifest["number"] = top + 1
        for n, _ in numbers[KEPT:]:
            fs, at = self._file(f"manifest-{n:012d}.json")
            fs.delete(at, False)

    def exists(self) -> bool:
        return self._newest() is not None

    # -- schema
    @property
    def keys(self) -> list[str]:
        return self.manifest["key"]

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(", ".join(f"`{c['name']}` {c['spark']}" for c in self.manifest["columns"]))

    def _conform(self, df: DataFrame) -> DataFrame:
        """df cast to the declared types; missing columns are their default."""
        cols, lower = [], {c.lower(): c for c in df.columns}
        unknown = set(lower) - {c["name"].lower() for c in self.manifest["columns"]}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        for c in self.manifest["columns"]:
            have = lower.get(c["name"].lower())
            value = F.col(f"`{have}`") if have else F.lit(c.get("default"))
            cols.append(value.cast(c["spark"]).alias(c["name"]))
        return df.select(*cols)

    def alter(self, add: tuple[str, str, object] | None = None, drop: str | None = None, rename: tuple[str, str] | None = None) -> None:
        """Metadata only: stored files keep a column's first name, reads map it by that."""
        m = self.manifest
        if add:
            m["columns"].append({"name": add[0], "stored": f"{add[0]}-{m['next_slot']}", "type": types.normalize(add[1])[0], "spark": types.normalize(add[1])[1], "default": add[2] if len(add) > 2 else None})
            m["next_slot"] += 1
        if drop:
            if drop in m["key"]:
                raise ValueError("a key column can't be dropped")
            if drop not in [c["name"] for c in m["columns"]]:
                raise KeyError(drop)
            m["columns"] = [c for c in m["columns"] if c["name"] != drop]
            m["required"] = [c for c in m.get("required", []) if c != drop]
            for kind in ("unique", "indexes"):
                m[kind] = {n: c for n, c in m.get(kind, {}).items() if drop not in c}
        if rename:
            to = lambda names: [rename[1] if c == rename[0] else c for c in names]
            if rename[0] not in [c["name"] for c in m["columns"]] or rename[1] in [c["name"] for c in m["columns"]]:
                raise ValueError(f"can't rename {rename[0]} to {rename[1]}")
            m["required"] = to(m.get("required", []))
            for kind in ("unique", "indexes"):
                m[kind] = {n: to(c) for n, c in m.get(kind, {}).items()}
            for c in m["columns"]:
                if c["name"] == rename[0]:
                    c["name"] = rename[1]
            m["key"] = [rename[1] if k == rename[0] else k for k in m["key"]]
        self._publish(m)

    def _stored(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c["name"]).alias(c["stored"]) for c in self.manifest["columns"]], *[c for c in ("seq", "op") if c in df.columns])

    def _read(self, paths: list[str], m: dict, log: bool = False) -> DataFrame:
        schema = ", ".join([f"`{c['stored']}` {c['spark']}" for c in m["columns"]] + (["seq bigint", "op string", "base bigint", "write string"] if log else []))
        df = self.spark.read.schema(schema).option("basePath", f"{self.path}/log" if log else paths[0]).parquet(*paths)
        return df.select(*[F.col(f"`{c['stored']}`").alias(c["name"]) for c in m["columns"]], *([(F.col("base") + F.col("seq")).alias("seq"), "op"] if log else []))

    # -- reads: of the newest manifest, or of one that the caller holds on to
    def snapshot(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest
        return self._read([f"{self.path}/{m['snapshot']}"], m) if m["snapshot"] else self.spark.createDataFrame([], self.schema)

    def log(self, sealed: int | None = None, m: dict | None = None) -> DataFrame | None:
        """Committed entries after ``sealed`` (what the snapshot holds); None where there are none."""
        m = m or self.manifest
        entries = [e for e in m["logs"] if not e.get("tx") or self.store.outcome(e["tx"]) == "committed"]
        if not entries:
            return None
        return self._read([f"{self.path}/log/{e['path']}" for e in entries], m, True).where(F.col("seq") > F.lit(m["sealed_seq"] if sealed is None else sealed))

    def read(self, min_seq: int = 0, m: dict | None = None) -> DataFrame:
        """Snapshot and log merged; a caller that needs ``min_seq`` gets an error where it is not committed."""
        m = m or self.manifest
        if min_seq > m["seq"]:
            raise ValueError(f"sequence {min_seq} is not committed; the table is at {m['seq']}")
        log = self.log(m=m)
        return self.snapshot(m) if log is None else changelog.merge(self.snapshot(m), log, m["key"])

    # -- writes
    def _settled(self) -> dict:
        """The newest manifest for a writer: transactions that are not over are aborted, so that nothing appears behind its back."""
        m = self.manifest
        logs = []
        for e in m["logs"]:
            if not e.get("tx"):
                logs.append(e)
            elif self.store.settle(e["tx"], "aborted") == "committed":
                logs.append({k: v for k, v in e.items() if k != "tx"})
        return m | {"logs": logs}

    def _stage(self, rows: DataFrame, m: dict, tx: str | None = None) -> tuple[int, dict]:
        """Writes rows (columns and op) to a log folder that no manifest names yet; how many, and the manifest that would."""
        base, write = m["seq"], uuid.uuid4().hex
        numbered = rows.withColumn("seq", F.monotonically_increasing_id() + 1)
        path = f"base={base}/write={write}"
        self._stored(numbered).write.parquet(f"{self.path}/log/{path}")
        n, top = self.spark.read.schema("seq bigint").parquet(f"{self.path}/log/{path}").agg(F.count(F.lit(1)), F.max("seq")).first()
        if not n:
            fs, at = self._file(f"log/{path}")
            fs.delete(at, True)
            return 0, m
        return n, m | {"seq": base + top, "logs": [*m["logs"], {"path": path, "top": base + top} | ({"tx": tx} if tx else {})]}

    def _append(self, rows: DataFrame, op: str, m: dict | None = None) -> int:
        n, new = self._stage(rows.withColumn("op", F.lit(op)), m or self._settled())
        if n:
            self._publish(new)
        return n

    def _required(self, rows: DataFrame, m: dict | None = None) -> None:
        if lacking := (m or self.manifest).get("required"):
            if rows.where(" or ".join(f"`{c}` is null" for c in lacking)).limit(1).count():
                raise ValueError(f"one of {lacking} is null")

    def _check(self, rows: DataFrame, others: DataFrame | None) -> None:
        self._required(rows)
        for name, cols in [("primary key", self.keys), *self.manifest["unique"].items()]:
            known = rows.where(" and ".join(f"`{c}` is not null" for c in cols))
            if name == "primary key" and known.count() != rows.count():
                raise ValueError("a key column is null")
            if known.groupBy(*cols).count().where("count > 1").limit(1).count() or others is not None and known.join(others, cols, "left_semi").limit(1).count():
                raise UniqueViolation(f"UNIQUE_VIOLATION: {name}")

    def insert(self, rows: DataFrame, upsert: bool = False) -> int:
        rows, m = self._conform(rows), self._settled()
        self._check(rows, None if upsert else self.read(m=m))
        return self._append(rows, changelog.UPSERT, m)

    def insert_returning(self, rows: DataFrame) -> DataFrame:
        """The rows as they were stored, by their keys."""
        self.insert(rows)
        return self.read().join(self._conform(rows).select(*self.keys), self.keys, "left_semi")

    def update_returning(self, assignments: dict[str, object], where: str | None = None) -> DataFrame:
        """The updated rows as they are afterwards, read back from the log folder of the update."""
        m = self._settled()
        self.update(assignments, where, m)
        return self._written(m["seq"])

    def delete_returning(self, where: str | None = None) -> DataFrame:
        """The deleted rows as they were, read back from the log folder of the delete."""
        m = self._settled()
        self.delete(where, m)
        return self._written(m["seq"])

    def _written(self, after: int) -> DataFrame:
        log = self.log(after)
        return (self.snapshot().limit(0) if log is None else log.drop("seq", "op")).select(*self.schema.names)

    def update(self, assignments: dict[str, object], where=None, m: dict | None = None) -> int:
        if set(assignments) & set(self.keys):
            raise ValueError("a key column can't be updated")
        m = m or self._settled()
        rows = self.read(m=m) if where is None else self.read(m=m).where(where)
        new = rows.withColumns({c: (v if hasattr(v, "_jc") else F.expr(v) if isinstance(v, str) else F.lit(v)) for c, v in assignments.items()})
        new = self._conform(new)
        self._required(new, m)
        for name, cols in m["unique"].items():
            if set(cols) & set(assignments):
                after = changelog.merge(self.read(m=m), new.withColumns({"op": F.lit(changelog.UPSERT), "seq": F.lit(1).cast("long")}), m["key"])
                self._distinct(name, cols, after)
        return self._append(new, changelog.UPSERT, m)

    def delete(self, where=None, m: dict | None = None) -> int:
        m = m or self._settled()
        rows = self.read(m=m)
        return self._append(rows if where is None else rows.where(where), changelog.DELETE, m)

    @staticmethod
    def _distinct(name: str, columns: list[str], rows: DataFrame) -> None:
        if rows.where(" and ".join(f"`{c}` is not null" for c in columns)).groupBy(*columns).count().where("count > 1").limit(1).count():
            raise UniqueViolation(f"UNIQUE_VIOLATION: {name}")

    def create_unique_index(self, name: str, columns: list[str]) -> None:
        m = self._settled()
        self._index(m, name, columns, "unique")
        self._distinct(name, columns, self.read(m=m))
        self._publish(m)

    def create_index(self, name: str, columns: list[str]) -> None:
        """Metadata only: sealed files are sorted by key, and scans prune by statistics."""
        m = self.manifest
        self._index(m, name, columns, "indexes")
        self._publish(m)

    def _index(self, m: dict, name: str, columns: list[str], kind: str) -> None:
        if name in m["unique"] or name in m.get("indexes", {}):
            raise ValueError(f"index {name} exists")
        if unknown := set(columns) - {c["name"] for c in m["columns"]}:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        m.setdefault(kind, {})[name] = columns

    def drop_index(self, name: str) -> None:
        m = self.manifest
        if m["unique"].pop(name, None) is None and m.get("indexes", {}).pop(name, None) is None:
            raise KeyError(name)
        self._publish(m)

    # -- sealing
    def seal(self, up_to: int | None = None) -> int:
        """A new snapshot of everything committed (or up to a sequence number); returns what it is sealed to."""
        m = self._settled()
        target = m["seq"] if up_to is None else min(up_to, m["seq"])
        if target <= m["sealed_seq"] and m["snapshot"]:
            return m["sealed_seq"]
        log = self.log(m=m)
        current = self.snapshot(m) if log is None else changelog.merge(self.snapshot(m), log.where(F.col("seq") <= target), m["key"])
        name = f"snapshot-{target}-{uuid.uuid4().hex[:8]}"
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        stored = {c["name"]: c["stored"] for c in m["columns"]}
        order = [stored[k] for k in m["key"]]
        self._stored(current).repartitionByRange(parts, *[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order]).write.parquet(f"{self.path}/{name}")
        self._publish(m | {"snapshot": name, "sealed_seq": target, "logs": [e for e in m["logs"] if e["top"] > target]})
        return target

    def compact(self, target_bytes: int = 128 << 20) -> int:
        """Rewrites the snapshot in files of about the target size, sorted by key; returns the number of files."""
        m = self.manifest
        if not m["snapshot"]:
            return 0
        fs, at = self._file(m["snapshot"])
        files = max(1, -(-fs.getContentSummary(at).getLength() // target_bytes))
        name = f"snapshot-{m['sealed_seq']}-{uuid.uuid4().hex[:8]}"
        stored = {c["name"]: c["stored"] for c in m["columns"]}
        order = [F.col(f"`{stored[k]}`") for k in m["key"]]
        self._stored(self.snapshot()).repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{self.path}/{name}")
        self._publish(m | {"snapshot": name})
        return files


class TableStore:
    """Tables of one tenant under a folder."""

    def __init__(self, spark: SparkSession, folder: str, tenant: str = "_"):
        self.spark, self.tenant = spark, tenant
        self.folder = f"{folder.rstrip('/')}/{'default' if tenant == '_' else tenant}"

    def outcome(self, tx: str) -> str | None:
        """'committed', 'aborted', or None while a transaction is not over."""
        return (read_small(self.spark, f"{self.folder}/_transactions/{tx}") or b"").decode() or None

    def settle(self, tx: str, outcome: str) -> str:
        """Ends a transaction unless it is over; how it ended.  The file is created once, whoever asks."""
        create_once(self.spark, f"{self.folder}/_transactions/{tx}", outcome.encode())
        return self.outcome(tx) or "aborted"

    def create(self, name: str, columns: dict[str, str], key: list[str], if_not_exists: bool = False, required: list[str] = (), defaults: dict | None = None, unique: dict | None = None) -> Table:
        for n in (name, *columns):
            if not _NAME.match(n):
                raise ValueError(f"not a name: {n!r}")
        if not key or set(key) - set(columns):
            raise ValueError("a table needs a primary key among its columns")
        t = Table(self, name)
        if t.exists():
            if if_not_exists:
                return t
            raise ValueError(f"table {name} exists")
        made = [{"name": n, "stored": f"{n}-{k}", "type": types.normalize(x)[0], "spark": types.normalize(x)[1], "default": (defaults or {}).get(n)} for k, (n, x) in enumerate(columns.items())]
        t._publish({"columns": made, "key": key, "unique": unique or {}, "indexes": {}, "required": list(required), "seq": 0, "sealed_seq": 0, "snapshot": None, "logs": [], "next_slot": len(made)})
        return t

    def create_as(self, name: str, df: DataFrame, key: list[str]) -> Table:
        names = {"bigint": "INTEGER", "int": "INTEGER", "double": "FLOAT", "float": "FLOAT", "string": "TEXT", "boolean": "BOOLEAN", "date": "DATE", "binary": "BYTEA", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
        t = self.create(name, {n: names.get(k, "DECIMAL" if k.startswith("decimal") else "TEXT") for n, k in df.dtypes}, key)
        t.insert(df)
        return t

    def table(self, name: str) -> Table:
        t = Table(self, name)
        if not t.exists():
            raise KeyError(name)
        return t

    def names(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(n for x in fs.listStatus(at) if not (n := x.getPath().getName()).startswith("_")) if fs.exists(at) else []

    def drop(self, name: str) -> None:
        fs, at = self.table(name)._file("")
        fs.delete(at.getParent() if at.getName() == "" else at, True)

    def rename(self, name: str, to: str) -> None:
        if not _NAME.match(to) or Table(self, to).exists():
            raise ValueError(f"can't rename {name} to {to}")
        fs, old = file_system(self.spark, self.table(name).path)
        if not fs.rename(old, file_system(self.spark, f"{self.folder}/{to}")[1]):
            raise RuntimeError(f"{name} could not be renamed")

    def columns(self) -> DataFrame:
        """(table_name, column_name, column_id, nullable, key, data_type) of all tables."""
        rows = [(n, c["name"], k, c["name"] not in m["key"], "PRIMARY KEY" if c["name"] in m["key"] else None, c["type"]) for n in self.names() for m in [self.table(n).manifest] for k, c in enumerate(m["columns"], 1)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, column_id int, nullable boolean, key string, data_type string")

    def indexes(self) -> DataFrame:
        rows = [(n, name, c, True) for n in self.names() for name, cols in self.table(n).manifest["unique"].items() for c in cols]
        rows += [(n, "PRIMARY", c, True) for n in self.names() for c in self.table(n).keys]
        return self.spark.createDataFrame(rows, "table_name string, index_name string, column_name string, uniqueness boolean")
