"""Queries for what the other modules of this package leave out: functions, search, documents, graphs, chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import collections as docs
from tessera.operators import evidence, graph, search
from tessera.plans import shapes
from tessera.plans.shapes import read
from tessera.session import Engine

QUERIES, ORACLE_SQL = {}, {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- functions


@registered("SELECT c_custkey, c_name || c_mktsegment AS a, concat_ws('-', c_name, NULL, c_mktsegment) AS b, c_name AS c, lower(hex(c_mktsegment)) AS d FROM customer")
def f_concat_hex(spark, sf_dir):
    return Engine(spark, sf_dir, ["customer"]).sql("SELECT c_custkey, concat(c_name, c_mktsegment) AS a, concat_ws('-', c_name, NULL, c_mktsegment) AS b, concat(c_name, NULL) AS c, hex(c_mktsegment) AS d FROM customer")


@registered("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, strptime(strftime(o_orderdate, '%d/%m/%Y 10:20:30'), '%d/%m/%Y %H:%M:%S') AS t FROM orders")
def f_to_date(spark, sf_dir):
    return Engine(spark, sf_dir, ["orders"]).sql("SELECT o_orderkey, to_date(to_char(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS d, to_timestamp(concat(to_char(o_orderdate, '%d/%m/%Y'), ' 10:20:30'), '%d/%m/%Y %H:%M:%S') AS t FROM orders")


@registered("SELECT count(*) AS n, count(*) AS inside, 36::BIGINT AS width, count(*) AS ids FROM customer")
def f_random(spark, sf_dir):
    """Random numbers lie in [0, 1); identifiers are 36 characters, each row's its own."""
    return Engine(spark, sf_dir, ["customer"]).sql("SELECT count(*) AS n, count(CASE WHEN r >= 0 AND r < 1 THEN 1 END) AS inside, CAST(max(length(u)) AS BIGINT) AS width, count(DISTINCT u) AS ids FROM (SELECT rand() AS r, generate_uuid() AS u FROM customer) x")


@registered("SELECT c_mktsegment AS seg, list_sort(list(DISTINCT c_nationkey)) AS nations, len(list(DISTINCT c_nationkey)) AS n FROM customer GROUP BY 1")
def f_collected_arrays(spark, sf_dir):
    return Engine(spark, sf_dir, ["customer"]).sql("SELECT c_mktsegment AS seg, array_sort(collect_set(c_nationkey)) AS nations, CAST(cardinality(collect_set(c_nationkey)) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment")


@registered("SELECT o_orderkey, o_orderstatus AS s, NULL::VARCHAR AS missing, 2::BIGINT AS n FROM orders")
def f_maps(spark, sf_dir):
    return Engine(spark, sf_dir, ["orders"]).sql("SELECT o_orderkey, try_element_at(m, 'status') AS s, try_element_at(m, 'none') AS missing, CAST(cardinality(map_keys(m)) AS BIGINT) AS n FROM (SELECT o_orderkey, map('status', o_orderstatus, 'priority', o_orderpriority) AS m FROM orders) x")


@registered("SELECT n_nationkey, n_name FROM nation ORDER BY nullif(n_nationkey, 5) DESC NULLS FIRST LIMIT 4")
def o_null_order_setting(spark, sf_dir):
    engine = Engine(spark, sf_dir, ["nation"])
    engine.set_null_order("first")
    return engine.sql("SELECT n_nationkey, n_name FROM nation ORDER BY nullif(n_nationkey, 5) DESC LIMIT 4")


_ANTI = "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_mktsegment = 'BUILDING' AND c_acctbal > 9000)"


@registered(_ANTI)
def j_anti_some(spark, sf_dir):
    return Engine(spark, sf_dir, ["supplier", "customer"]).sql(_ANTI)


# -- the structured search language


def _index(spark, sf_dir) -> search.Index:
    df = read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "_id")
    return search.Index(df, {"text": {"type": "text", "analyzer": "standard"}, "lang": {"type": "keyword"}, "n_chars": {"type": "long"}})


@registered("SELECT doc_id AS _id FROM documents")
def e_match_all(spark, sf_dir):
    return _index(spark, sf_dir).ids({"match_all": {}})


@registered("SELECT doc_id AS _id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])rights[^\\p{L}\\p{N}]+reserved($|[^\\p{L}\\p{N}])')")
def e_match_phrase(spark, sf_dir):
    return _index(spark, sf_dir).ids({"match_phrase": {"text": "Rights reserved"}})


@registered("SELECT doc_id AS _id FROM documents WHERE lang IS NOT NULL")
def e_exists(spark, sf_dir):
    return _index(spark, sf_dir).ids({"exists": {"field": "lang"}})


@registered("SELECT doc_id AS _id FROM documents WHERE lang = 'de' OR n_chars < 300")
def e_should(spark, sf_dir):
    return _index(spark, sf_dir).ids({"bool": {"should": [{"term": {"lang": "de"}}, {"range": {"n_chars": {"lt": 300}}}]}})


@registered("SELECT doc_id AS _id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 15 OFFSET 5")
def e_request(spark, sf_dir):
    return _index(spark, sf_dir).hits({"query": {"term": {"lang": "en"}}, "from": 5, "size": 15, "sort": [{"n_chars": "desc"}], "_source": ["n_chars"]}).select("_id", "n_chars")


@registered("SELECT doc_id AS _id, regexp_replace(text, '(^|[^\\p{L}\\p{N}])((?i:reserved|rights)[\\p{L}\\p{N}]*)', '\\1<em>\\2</em>', 'g') AS marked FROM documents")
def e_highlight(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), search.highlight(F.col("text"), ["rights", "reserved"]).alias("marked"))


# -- documents


@registered("SELECT CAST(c_custkey AS VARCHAR) AS _id, c_mktsegment AS copy, 'k' AS fixed FROM customer WHERE c_nationkey = 4")
def c_add_fields(spark, sf_dir):
    got = docs.pipeline(shapes._customers(spark, sf_dir), [{"$match": {"nation": {"$eq": 4}}}, {"$addFields": {"copy": "$seg", "fixed": "k"}}])
    return got.select("_id", "copy", "fixed")


@registered("SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name AS name, NULL::VARCHAR AS bal FROM customer")
def c_project_documents(spark, sf_dir):
    got = docs.project_documents(shapes._customers(spark, sf_dir), {"name": 1, "seg": 1})
    return got.select("_id", F.get_json_object("doc", "$.name").alias("name"), F.get_json_object("doc", "$.bal").alias("bal"))


# -- graphs


@registered(f"SELECT src, dst, 'supplies' AS type, CASE WHEN src = 's2' THEN greatest(weight, 100::BIGINT) ELSE weight END AS weight FROM {shapes._EDGES} WHERE src <> 's1'")
def g_mutate(spark, sf_dir):
    """A batch raises one supplier's edges to 100 at least, and deletes another's."""
    edges = shapes._edges(spark, sf_dir)
    return graph.mutate(edges, edges.where("src = 's2'").withColumn("weight", F.lit(100).cast("long")), edges.where("src = 's1'"), "max")


# -- chains


def _entries(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("chain"), F.col("role").alias("type"), F.col("text").alias("payload"), F.col("turn").cast("string").alias("at"))


def _chain(spark, sf_dir):
    empty = spark.createDataFrame([], "chain string, seq long, type string, payload string, at string, leaf_hash string, redacted boolean")
    return evidence.append(empty, _entries(spark, sf_dir), ["at", "type", "payload"])


_APPENDED = "SELECT conv_id::VARCHAR AS chain, row_number() OVER (PARTITION BY conv_id ORDER BY turn::VARCHAR NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS seq, role AS type, text AS payload FROM conversations"


@registered(_APPENDED)
def v_append(spark, sf_dir):
    return _chain(spark, sf_dir).select("chain", "seq", "type", "payload")


@registered(f"SELECT seq, type, payload FROM ({_APPENDED}) WHERE chain = '1' AND seq >= 1 ORDER BY seq LIMIT 3")
def v_page(spark, sf_dir):
    return evidence.page(_chain(spark, sf_dir), "1", 1, 3).select("seq", "type", "payload")


@registered(f"SELECT chain, seq, CASE WHEN chain = '1' AND seq = 0 THEN NULL ELSE payload END AS payload, chain = '1' AND seq = 0 AS redacted FROM ({_APPENDED})")
def v_redact(spark, sf_dir):
    return evidence.redact(_chain(spark, sf_dir), "1", 0).select("chain", "seq", "payload", "redacted")
