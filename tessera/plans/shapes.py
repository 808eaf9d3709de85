"""Queries beyond plain SQL: merged logs, collections, query strings, search, graphs, chains, ledgers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import rest
from tessera.functions import hll
from tessera.operators import collections as docs
from tessera.operators import evidence, graph, ledger, search
from tessera.sources import changelog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- change logs: keys ending in 1 are updated, in 2 deleted, in 3 deleted and written again


def _order_log(orders: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", "o_custkey", "o_totalprice")
    of = lambda r, op, at, price="o_totalprice": rows.where(F.col("o_orderkey") % 10 == r).select("o_orderkey", "o_custkey", F.expr(price).alias("o_totalprice"), F.lit(op).alias("op"), (F.col("o_orderkey") * 4 + at).alias("seq"))
    log = of(1, "upsert", 0, "o_totalprice + 1").unionByName(of(1, "upsert", 1, "o_totalprice + 2")).unionByName(of(2, "delete", 0))
    return log.unionByName(of(3, "delete", 0)).unionByName(of(3, "upsert", 1, "o_totalprice + 5"))


_MERGED = "SELECT o_orderkey, o_custkey, o_totalprice + CASE o_orderkey % 10 WHEN 1 THEN 2 WHEN 3 THEN 5 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 2"


@registered(_MERGED)
def s_merge_scan(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return changelog.merge(orders.select("o_orderkey", "o_custkey", "o_totalprice"), _order_log(orders), ["o_orderkey"])


@registered(f"SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM ({_MERGED}) GROUP BY o_custkey")
def s_merge_aggregate(spark, sf_dir):
    return s_merge_scan(spark, sf_dir).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))


@registered(f"SELECT * FROM ({_MERGED}) WHERE o_orderkey = 33")
def s_point_read(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return changelog.lookup(orders.select("o_orderkey", "o_custkey", "o_totalprice"), _order_log(orders), o_orderkey=33)


@registered(f"SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM ({_MERGED})")
def w_over_merge(spark, sf_dir):
    return s_merge_scan(spark, sf_dir).selectExpr("o_orderkey", "rank() over (partition by o_custkey order by o_totalprice, o_orderkey) as r")


@registered("WITH b AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, q FROM b WHERE l_linenumber <> 2 UNION ALL SELECT l_orderkey, l_linenumber, -1.0 FROM b WHERE l_linenumber = 2 AND l_orderkey % 2 = 0")
def s_merge_composite_key(spark, sf_dir):
    base = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    two = base.where("l_linenumber = 2")
    log = two.selectExpr("l_orderkey", "l_linenumber", "-1.0D as q", "if(l_orderkey % 2 = 0, 'upsert', 'delete') as op", "cast(1 as bigint) as seq")
    return changelog.merge(base, log, ["l_orderkey", "l_linenumber"])


@registered("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS seq FROM events GROUP BY user_id")
def w2_collapse(spark, sf_dir):
    log = read(spark, sf_dir, "events").selectExpr("user_id", "event_type", "event_id as seq")
    return changelog.collapse(log, ["user_id"]).select("user_id", "event_type", "seq")


# -- collections: customers as documents


def _customers(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("_id"), F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"), F.expr("if(c_custkey % 3 = 0, null, array('a', cast(c_custkey % 5 as string)))").alias("tags"))).alias("doc"))


def _orders(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("_id"), F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cust"), F.col("o_orderstatus").alias("st"))).alias("doc"))


@registered("SELECT CAST(c_custkey AS VARCHAR) AS _id FROM customer WHERE c_nationkey >= 5 AND c_nationkey < 20 AND (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_acctbal < 0)")
def c_match(spark, sf_dir):
    return docs.pipeline(_customers(spark, sf_dir), [{"$match": {"nation": {"$gte": 5, "$lt": 20}, "$or": [{"seg": {"$in": ["BUILDING", "MACHINERY"]}}, {"bal": {"$lt": 0}}]}}]).select("_id")


@registered("SELECT CAST(c_custkey AS VARCHAR) AS _id FROM customer WHERE c_nationkey <> 3 AND regexp_matches(c_name, '1$')")
def c_find(spark, sf_dir):
    return docs.find(_customers(spark, sf_dir), {"nation": {"$ne": 3}, "name": {"$regex": "1$"}}).select("_id")


@registered("SELECT CAST(c_custkey AS VARCHAR) AS _id FROM customer WHERE c_custkey % 3 = 0")
def c_exists(spark, sf_dir):
    return docs.find(_customers(spark, sf_dir), {"tags": {"$exists": False}}).select("_id")


@registered("SELECT c_mktsegment AS _id, count(*) AS n, round(sum(c_acctbal), 2) AS total, min(c_nationkey)::DOUBLE AS lo FROM customer WHERE c_nationkey <> 7 GROUP BY 1")
def c_group(spark, sf_dir):
    got = docs.pipeline(_customers(spark, sf_dir), [{"$match": {"nation": {"$ne": 7}}}, {"$group": {"_id": "$seg", "n": {"$sum": 1}, "total": {"$sum": "$bal"}, "lo": {"$min": "$nation"}}}])
    return got.withColumn("total", F.round("total", 2))


@registered("SELECT tag AS _id, count(*) AS n FROM (SELECT unnest(['a', CAST(c_custkey % 5 AS VARCHAR)]) AS tag FROM customer WHERE c_custkey % 3 <> 0) GROUP BY 1")
def c_unwind_group(spark, sf_dir):
    return docs.pipeline(_customers(spark, sf_dir), [{"$unwind": "$tags"}, {"$group": {"_id": "$tags", "n": {"$sum": 1}}}])


@registered("SELECT CAST(c_custkey AS VARCHAR) AS _id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def c_lookup(spark, sf_dir):
    got = docs.pipeline(_customers(spark, sf_dir), [{"$lookup": {"from": "orders", "localField": "_id", "foreignField": "cust", "as": "os"}}], {"orders": _orders(spark, sf_dir)})
    return got.select("_id", F.size("os").cast("long").alias("n"))


@registered("SELECT c_name AS who, c_mktsegment AS seg FROM customer ORDER BY c_name LIMIT 10 OFFSET 5")
def c_sort_project(spark, sf_dir):
    return docs.pipeline(_customers(spark, sf_dir), [{"$sort": {"name": 1}}, {"$skip": 5}, {"$limit": 10}, {"$project": {"who": "$name", "seg": 1, "bal": 0}}])


@registered("SELECT count(*) AS n FROM customer WHERE c_acctbal > 100")
def c_count(spark, sf_dir):
    return docs.pipeline(_customers(spark, sf_dir), [{"$match": {"bal": {"$gt": 100}}}, {"$count": "n"}])


@registered("SELECT CAST(c_custkey AS VARCHAR) AS _id, (c_nationkey + 5)::VARCHAR AS nation, 'x' AS flag FROM customer WHERE c_mktsegment = 'BUILDING'")
def c_update(spark, sf_dir):
    got = docs.update(_customers(spark, sf_dir), {"seg": "BUILDING"}, {"$inc": {"nation": 5}, "$set": {"flag": "x"}, "$unset": {"bal": 1}}, multi=True)
    return got.select("_id", F.get_json_object("doc", "$.nation").alias("nation"), F.get_json_object("doc", "$.flag").alias("flag"))


# -- query strings


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 50000 AND NOT (o_orderstatus = 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 3")
def p_rest_query(spark, sf_dir):
    return rest.Query.parse("select=o_orderkey,o_totalprice&o_totalprice=gte.50000&o_orderstatus=not.eq.F&o_orderpriority=in.(1-URGENT,2-HIGH)&order=o_totalprice.desc,o_orderkey&limit=15&offset=3").run(read(spark, sf_dir, "orders"))


@registered("SELECT count(*) AS total FROM orders WHERE o_orderstatus LIKE '%O%'")
def a_rest_total(spark, sf_dir):
    return rest.Query.parse("o_orderstatus=like.%O%&limit=5").total(read(spark, sf_dir, "orders"))


# -- search


_TERMS = "(SELECT doc_id AS pk, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' AND strlen(x) <= 40)) AS term FROM documents)"


@registered(f"SELECT pk FROM {_TERMS} WHERE term IN ('the', 'tion') GROUP BY pk HAVING count(DISTINCT term) = 2")
def t_plain_query(spark, sf_dir):
    posts = search.postings(read(spark, sf_dir, "documents"), "doc_id", "text")
    return search.matches(posts, search.plain("the tion", "default"))


@registered(f"SELECT DISTINCT pk FROM {_TERMS} WHERE term IN ('license', 'licensed', 'rights') AND pk NOT IN (SELECT pk FROM {_TERMS} WHERE term = 'password')")
def t_tsquery(spark, sf_dir):
    posts = search.postings(read(spark, sf_dir, "documents"), "doc_id", "text")
    return search.matches(posts, search.tsquery("(license | licensed | rights) & !password", "default"))


@registered("SELECT doc_id AS pk FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])all[^\\p{L}\\p{N}]+rights[^\\p{L}\\p{N}]+reserved($|[^\\p{L}\\p{N}])')")
def t_phrase(spark, sf_dir):
    posts = search.postings(read(spark, sf_dir, "documents"), "doc_id", "text")
    return search.matches(posts, search.websearch('"all rights reserved"', "default"))


@registered(
    f"""WITH p AS (SELECT pk, term, count(*) AS tf FROM {_TERMS} GROUP BY 1, 2), s AS (SELECT pk, sum(tf) AS len FROM p GROUP BY 1), n AS (SELECT count(*) AS n, avg(len) AS mean FROM s),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
    SELECT p.pk, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score
    FROM p JOIN s USING (pk) JOIN d USING (term), n WHERE term IN ('rights', 'reserved') GROUP BY p.pk"""
)
def t_bm25(spark, sf_dir):
    return search.bm25_scan(read(spark, sf_dir, "documents"), "doc_id", "text", ["rights", "reserved"]).select("pk", F.round("score", 6).alias("score"))


@registered("SELECT doc_id FROM documents WHERE text LIKE '%rights reserved%'")
def t_infix_like(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text like '%rights reserved%'").select("doc_id")


@registered(f"SELECT DISTINCT d.doc_id AS _id FROM documents d JOIN {_TERMS} t ON t.pk = d.doc_id WHERE t.term IN ('rights', 'reserved') AND d.lang = 'en' AND d.n_chars >= 1000 AND d.source <> 'src0'")
def e_bool_query(spark, sf_dir):
    df = read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "_id")
    index = search.Index(df, {"text": {"type": "text", "analyzer": "standard"}, "lang": {"type": "keyword"}, "source": {"type": "keyword"}, "n_chars": {"type": "long"}})
    return index.ids({"bool": {"must": [{"match": {"text": "rights reserved"}}], "filter": [{"term": {"lang": "en"}}, {"range": {"n_chars": {"gte": 1000}}}], "must_not": [{"term": {"source": "src0"}}]}})


# -- windows: one global numbering


@registered("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders")
def w_row_number_all(spark, sf_dir):
    """All orders: numbers within ranges, plus the rows of the ranges before; no task holds the whole table."""
    key = [F.col("o_totalprice").asc_nulls_last(), F.col("o_orderkey").asc_nulls_last()]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartitionByRange(parts, *key).sortWithinPartitions(*key)
    spread = spread.withColumn("_at", F.monotonically_increasing_id())
    numbered = graph._save(spread.select("o_orderkey", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_at")))
    ranges = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # one row for each range
    ranges = ranges.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(ranges), "_part").select("o_orderkey", (F.col("_before") + F.col("_at") + 1).alias("rn"))


# -- graph: suppliers to parts


def _edges(spark, sf_dir) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    sums = li.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("weight"))
    return sums.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), F.lit("supplies").alias("type"), "weight")


_EDGES = "(SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CAST(sum(l_quantity) AS BIGINT) AS weight FROM lineitem GROUP BY 1, 2)"


@registered(f"SELECT dst AS node, weight, 'supplies' AS type FROM {_EDGES} WHERE src = 's3' AND weight >= 50")
def g_neighbours(spark, sf_dir):
    return graph.neighbours(_edges(spark, sf_dir), "s3", "out", 50)


@registered(f"WITH RECURSIVE e AS (SELECT src, dst FROM {_EDGES} WHERE weight >= 120), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(node) AS (SELECT 's1' UNION SELECT u.dst FROM r JOIN u ON u.src = r.node) SELECT node FROM r")
def g_reachable(spark, sf_dir):
    return graph.reachable(_edges(spark, sf_dir), spark.range(1).select(F.lit("s1").alias("node")), floor=120, directed=False)


@registered(f"WITH RECURSIVE e AS (SELECT src, dst, weight FROM {_EDGES} WHERE src IN ('s1', 's2', 's3')), u AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e), r(node, w) AS (SELECT 's1', 9000000000000::BIGINT UNION SELECT u.dst, least(r.w, u.weight) FROM r JOIN u ON u.src = r.node) SELECT node, CASE WHEN node <> 's1' THEN max(w) END AS bottleneck FROM r GROUP BY node")
def g_widest(spark, sf_dir):
    return graph.widest(_edges(spark, sf_dir).where("src in ('s1', 's2', 's3')"), "s1", directed=False)


@registered()
def g_widest_all(spark, sf_dir):
    """Over all edges.  No SQL: a recursive query enumerates paths; tests hold it against brute force."""
    return graph.widest(_edges(spark, sf_dir), "s1", directed=False)


# -- chains: conversations


def _entries(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    seq = F.expr("row_number() over (partition by conv_id order by turn, role, text) - 1").cast("long")
    return c.select(F.col("conv_id").alias("chain"), seq.alias("seq"), evidence.leaf_hash(F.col("role"), F.col("text"), F.col("turn").cast("string")).alias("leaf_hash"))


_FRAME = "unhex(lpad(lower(printf('%x', octet_length({0}))), 16, '0')) || {0}"


@registered(
    "SELECT conv_id AS chain, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::BIGINT AS seq, sha256(unhex('00') || " + " || ".join(_FRAME.format(x) for x in ("encode(role)", "encode(text)", "encode(turn::VARCHAR)")) + " || unhex('0000000000000000')) AS leaf_hash FROM conversations"
)
def v_leaf_hashes(spark, sf_dir):
    return _entries(spark, sf_dir)


@registered()
def v_roots(spark, sf_dir):
    return evidence.roots(_entries(spark, sf_dir))


# -- ledger: orders as transfers from customers to clerks


def _transfers(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 7 + 1).cast("long").alias("ledger"), F.col("o_orderkey").cast("long").alias("seq"), (F.col("o_orderkey") + 1).cast("string").alias("id"), ((F.col("o_custkey") % 7 + 1) * 1000000 + F.col("o_custkey")).cast("string").alias("debit"), ((F.col("o_custkey") % 7 + 1) * 1000000 + 900000).cast("string").alias("credit"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("amount"), F.lit(1).cast("long").alias("code"), F.lit(0).cast("long").alias("flags"), F.lit("0").alias("pending_id"))


@registered("SELECT (o_custkey % 7 + 1)::BIGINT AS ledger, o_orderkey::BIGINT AS seq, (o_orderkey + 1)::VARCHAR AS id, 'ok' AS result FROM orders")
def l_transfers(spark, sf_dir):
    return ledger.run(_transfers(spark, sf_dir))


@registered("SELECT account, sum(d)::DOUBLE AS debits_posted, sum(c)::DOUBLE AS credits_posted FROM (SELECT ((o_custkey % 7 + 1) * 1000000 + o_custkey)::VARCHAR AS account, round(o_totalprice * 100)::BIGINT AS d, 0 AS c FROM orders UNION ALL SELECT ((o_custkey % 7 + 1) * 1000000 + 900000)::VARCHAR, 0, round(o_totalprice * 100)::BIGINT FROM orders) GROUP BY 1")
def l_balances(spark, sf_dir):
    got = ledger.balances(_transfers(spark, sf_dir))
    return got.select("account", F.col("debits_posted").cast("double").alias("debits_posted"), F.col("credits_posted").cast("double").alias("credits_posted"))


@registered("SELECT event_type, true AS close FROM events GROUP BY event_type")
def a_hll_registers(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    got = hll.estimate(hll.merge(hll.registers(e, F.col("user_id"), "event_type"), "event_type"), "event_type")
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("d"))
    return got.join(exact, "event_type").select("event_type", (F.abs(F.col("distinct") - F.col("d")) <= 0.05 * F.col("d") + 1).alias("close"))
