"""Queries over stored tables: what statements, seals and transactions leave behind."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir
from tessera.sources.table_store import TableStore, UniqueViolation
from tessera.statements import Database

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str, tables: tuple[str, ...] = ("customer",)):
    """A query that gets a database with an empty store, and the driver's tables under their names."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            store = TableStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
            return f(Database(spark, store, folder=sf_dir, tables=tables))

        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = run, sql
        return f

    return add


def _accounts(db: Database) -> None:
    db.execute("CREATE TABLE accounts (id INTEGER PRIMARY KEY, name TEXT NOT NULL, bal FLOAT, nation INTEGER DEFAULT 3 + 4)")
    db.execute("INSERT INTO accounts (id, name, bal) SELECT c_custkey, c_name, c_acctbal FROM customer")


_ACCOUNTS = "SELECT c_custkey::BIGINT AS id, c_name AS name, c_acctbal AS bal, 7::BIGINT AS nation FROM customer"


@registered(_ACCOUNTS)
def d_create_insert(db):
    _accounts(db)
    return db.execute("SELECT id, name, bal, nation FROM accounts")


@registered(f"SELECT * FROM ({_ACCOUNTS}) WHERE bal > (SELECT avg(c_acctbal) FROM customer)")
def d_create_as(db):
    _accounts(db)
    db.execute("CREATE TABLE rich AS WITH mean AS (SELECT avg(bal) AS m FROM accounts) SELECT a.* FROM accounts a, mean WHERE bal > m")
    return db.execute("SELECT * FROM rich")


@registered(f"SELECT id, name, CASE WHEN id % 3 = 1 THEN bal + 1 ELSE bal END AS bal, CASE WHEN id % 3 = 1 THEN 9::BIGINT ELSE nation END AS nation FROM ({_ACCOUNTS}) WHERE id % 3 <> 0")
def d_update_delete(db):
    _accounts(db)
    db.execute("UPDATE accounts SET bal = bal + 1, nation = ? WHERE id % 3 = 1", [9])
    db.execute("DELETE FROM accounts WHERE id % 3 = 0")
    return db.execute("SELECT * FROM accounts")


@registered(f"SELECT id, bal * 2 AS twice FROM ({_ACCOUNTS}) WHERE bal < 0")
def d_update_returning(db):
    _accounts(db)
    return db.execute("UPDATE accounts SET bal = bal * 2 WHERE bal < 0 RETURNING id, bal AS twice")


@registered(f"SELECT id, name FROM ({_ACCOUNTS}) WHERE id % 5 = 2")
def d_delete_returning(db):
    _accounts(db)
    return db.execute("DELETE FROM accounts WHERE id % 5 = 2 RETURNING id, name")


@registered(f"SELECT id, name AS label, CASE WHEN id < 0 THEN 'x' END AS note FROM ({_ACCOUNTS}) UNION ALL SELECT -1, 'none', 'new'")
def d_alter(db):
    _accounts(db)
    db.execute("ALTER TABLE accounts RENAME COLUMN name TO label")
    db.execute("ALTER TABLE accounts DROP COLUMN bal")
    db.execute("ALTER TABLE accounts DROP COLUMN nation")
    db.execute("ALTER TABLE accounts ADD COLUMN note TEXT")
    db.execute("ALTER TABLE accounts RENAME TO people")
    db.execute("INSERT INTO people VALUES (-1, 'none', 'new')")
    return db.execute("SELECT * FROM people")


@registered("SELECT count(*) AS n, true AS rejected, count(DISTINCT c_name) AS names FROM customer")
def d_unique_index(db):
    """A name that is there already is refused by the index, and nothing of the insert is kept."""
    _accounts(db)
    db.execute("CREATE UNIQUE INDEX accounts_name ON accounts (name)")
    try:
        db.execute("INSERT INTO accounts (id, name) SELECT -1 - c_custkey, c_name FROM customer")
        rejected = False
    except UniqueViolation:
        rejected = True
    return db.execute("SELECT count(*) AS n, CAST(? AS BOOLEAN) AS rejected, count(DISTINCT name) AS names FROM accounts", [rejected])


@registered(f"SELECT nation, count(*) AS n FROM ({_ACCOUNTS}) WHERE bal > 0 GROUP BY nation")
def d_view(db):
    _accounts(db)
    db.execute("CREATE VIEW solvent AS SELECT * FROM accounts WHERE bal > 0")
    db.execute("CREATE VIEW solvent_by_nation AS SELECT nation, count(*) AS n FROM solvent GROUP BY nation")
    return db.execute("SELECT * FROM solvent_by_nation")


@registered(f"SELECT id, name, bal + 10 AS bal, nation FROM ({_ACCOUNTS}) WHERE id % 2 = 0 UNION ALL SELECT -1, 'zero', 0, 1")
def d_transaction(db):
    """Changes of one transaction, committed together; another one is rolled back."""
    _accounts(db)
    db.execute("BEGIN")
    db.execute("UPDATE accounts SET bal = bal + 10")
    db.execute("DELETE FROM accounts WHERE id % 2 = 1")
    db.execute("INSERT INTO accounts VALUES (-1, 'zero', 0, 1)")
    db.execute("COMMIT")
    db.execute("BEGIN")
    db.execute("DELETE FROM accounts")
    db.execute("ROLLBACK")
    return db.execute("SELECT * FROM accounts")


@registered(f"{_ACCOUNTS} WHERE c_custkey % 4 <> 0")
def s_snapshot_read(db):
    """What a transaction reads after another writer's insert: the table of its first touch, and its own delete."""
    _accounts(db)
    db.execute("BEGIN")
    db.execute("DELETE FROM accounts WHERE id % 4 = 0")
    Database(db.spark, db.store).execute("INSERT INTO accounts VALUES (-1, 'other', 0, 0)")
    return db.execute("SELECT * FROM accounts")


@registered("SELECT c_custkey::BIGINT AS id, c_acctbal AS sealed, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS fresh FROM customer")
def s_sealed_and_fresh(db):
    """A table's sealed snapshot beside the merged read of snapshot and log."""
    _accounts(db)
    t = db.store.table("accounts")
    t.seal()
    db.execute("UPDATE accounts SET bal = bal + 1 WHERE id % 2 = 0")
    return t.snapshot().select("id", F.col("bal").alias("sealed")).join(t.read().select("id", F.col("bal").alias("fresh")), "id")


@registered(f"SELECT id, bal FROM ({_ACCOUNTS}) WHERE id % 7 <> 0")
def s_compacted(db):
    """The same rows after deletes, a seal and a compaction into few sorted files."""
    _accounts(db)
    db.execute("DELETE FROM accounts WHERE id % 7 = 0")
    t = db.store.table("accounts")
    t.seal()
    t.compact()
    return t.snapshot().select("id", "bal")


@registered("SELECT * FROM (VALUES ('accounts', 'id', 1, 'INTEGER'), ('accounts', 'name', 2, 'TEXT'), ('accounts', 'bal', 3, 'FLOAT'), ('accounts', 'nation', 4, 'INTEGER')) AS t(table_name, column_name, column_id, data_type)")
def s_metadata(db):
    _accounts(db)
    return db.store.columns().select("table_name", "column_name", "column_id", "data_type")
