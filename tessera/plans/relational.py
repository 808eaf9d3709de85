"""Relational queries in the dialect, and the same for DuckDB where the text differs.

Sums of floating-point columns are rounded on both sides, as their order differs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import TABLES, Engine

#: name: (text in the dialect, text for DuckDB or None where it is the same)
SQL: dict[str, tuple[str, str | None]] = {
    "rel_pricing_summary": (
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, count(*) AS count_order
           FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
        None,
    ),
    # projection, predicates, coercion
    "p_arithmetic": ("SELECT o_orderkey, o_orderkey + 1 AS a, o_orderkey - 1 AS s, o_orderkey * 2 AS m, o_orderkey % 7 AS r, 7 DIV 2 AS d FROM orders", "SELECT o_orderkey, o_orderkey + 1 AS a, o_orderkey - 1 AS s, o_orderkey * 2 AS m, o_orderkey % 7 AS r, 7 // 2 AS d FROM orders"),
    "p_predicates": ("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey IN (1, 2, 3, 4, 5) AND c_mktsegment NOT IN ('BUILDING') AND NOT (c_acctbal = 0) AND c_name IS NOT NULL", None),
    "p_null_logic": ("SELECT count(*) AS n, count(CASE WHEN nullif(c_nationkey, 3) > 1 THEN 1 END) AS a, count(CASE WHEN (nullif(c_nationkey, 3) > 1) IS NOT TRUE THEN 1 END) AS b, count(CASE WHEN nullif(c_nationkey, 3) IS NULL OR c_acctbal > 0 THEN 1 END) AS c FROM customer", None),
    "p_like": ("SELECT p_partkey FROM part WHERE p_name ILIKE '%A%' AND p_type LIKE '%E%' AND p_brand NOT LIKE '%#1%'", None),
    "p_case": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS st, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS sz FROM orders", None),
    "p_cast": ("SELECT o_orderkey, CAST(o_orderkey AS TEXT) AS t, o_orderkey::FLOAT AS f, TRY_CAST(o_orderstatus AS INTEGER) AS n, TRY_CAST('12' AS INTEGER) AS k FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS t, o_orderkey::DOUBLE AS f, TRY_CAST(o_orderstatus AS BIGINT) AS n, TRY_CAST('12' AS BIGINT) AS k FROM orders"),
    "p_text_number": ("SELECT c_custkey FROM customer WHERE c_mktsegment = '5' OR c_custkey = '7'", None),
    "p_keyset": ("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) > (CAST(100 AS BIGINT), CAST(3 AS INT32)) ORDER BY l_orderkey, l_linenumber LIMIT 50", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 3) ORDER BY l_orderkey, l_linenumber LIMIT 50"),
    "p_values": ("SELECT c.a, c.b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS c(a, b)", None),
    "p_series": ("SELECT id AS n FROM range(1, 101)", "SELECT range AS n FROM range(1, 101)"),
    # joins
    "j_inner_chain": ("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name", None),
    "j_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", None),
    "j_right": ("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'", None),
    "j_full": ("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal", None),
    "j_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "j_self": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1", None),
    "j_using": ("SELECT n_nationkey, x.n_name AS a, y.n_regionkey AS b FROM nation x JOIN nation y USING (n_nationkey)", None),
    "j_comma": ("SELECT n_name, s_name FROM nation, supplier WHERE n_nationkey = s_nationkey", None),
    "j_theta": ("SELECT a.r_regionkey AS x, b.n_nationkey AS y FROM region a JOIN nation b ON a.r_regionkey * 5 < b.n_nationkey", None),
    "j_semi": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", None),
    "j_anti": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "j_not_in_null": ("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 2) FROM region)", None),
    # aggregation
    "a_basic": ("SELECT o_orderstatus, count(*) AS n, count(o_custkey) AS k, round(sum(o_totalprice), 2) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS m FROM orders GROUP BY o_orderstatus", None),
    "a_group_expr_having": ("SELECT o_custkey % 10 AS g, count(DISTINCT o_orderpriority) AS p, count(*) AS n FROM orders GROUP BY o_custkey % 10 HAVING count(*) > 3", None),
    "a_empty": ("SELECT count(*) AS n, sum(o_orderkey) AS s FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders WHERE o_orderkey < 0"),
    "a_spread": ("SELECT l_returnflag, round(variance(l_quantity), 4) AS v, round(stdev(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS vp, round(stddev_pop(l_quantity), 4) AS sp FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(var_samp(l_quantity), 4) AS v, round(stddev_samp(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS vp, round(stddev_pop(l_quantity), 4) AS sp FROM lineitem GROUP BY l_returnflag"),
    "a_rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "a_cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "a_grouping_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None),
    "a_filter_array": ("SELECT n_regionkey, sort_array(collect_list(n_name) FILTER (WHERE n_nationkey > 3)) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, coalesce(list_sort(list(n_name) FILTER (WHERE n_nationkey > 3)), []) AS names FROM nation GROUP BY n_regionkey"),
    "a_bool_median": ("SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS ba, bool_or(o_totalprice > 300000) AS bo, round(median(o_totalprice), 4) AS md, round(corr(o_totalprice, o_custkey), 6) AS co FROM orders GROUP BY o_orderstatus", None),
    "a_string_agg": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "a_approx_within": ("SELECT abs(approx_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS close, abs(approx_percentile(o_totalprice, 0.5) - median(o_totalprice)) <= 0.05 * median(o_totalprice) AS near, abs(approx_median(o_totalprice) - median(o_totalprice)) <= 0.05 * median(o_totalprice) AS mid FROM orders", "SELECT true AS close, true AS near, true AS mid"),
    "a_hll_within": ("SELECT abs(hll_count(hll_merge(s)) - max(d)) <= 0.05 * max(d) AS close FROM (SELECT o_orderstatus, hll_build(o_custkey) AS s, (SELECT count(DISTINCT o_custkey) FROM orders) AS d FROM orders GROUP BY o_orderstatus) t", "SELECT true AS close"),
    # windows
    "w_row_number": ("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders WHERE o_orderkey < 5000", None),
    "w_running": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS c, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS s FROM orders", None),
    "w_lag_lead": ("SELECT o_orderkey, lag(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders", None),
    "w_ranks": ("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment), 6) AS p, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment), 6) AS cd, ntile(3) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nt FROM customer", None),
    "w_values": ("SELECT c_custkey, first_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS f, last_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2 FROM customer", None),
    "w_frames": ("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS ma, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM orders", None),
    # order, limit, distinct, sets
    "o_null_largest_asc": ("SELECT n_nationkey, nullif(n_regionkey, 2) AS v FROM nation ORDER BY v, n_nationkey LIMIT 22", "SELECT n_nationkey, nullif(n_regionkey, 2) AS v FROM nation ORDER BY v ASC NULLS LAST, n_nationkey LIMIT 22"),
    "o_null_largest_desc": ("SELECT n_nationkey, nullif(n_regionkey, 2) AS v FROM nation ORDER BY v DESC, n_nationkey LIMIT 7", "SELECT n_nationkey, nullif(n_regionkey, 2) AS v FROM nation ORDER BY v DESC NULLS FIRST, n_nationkey LIMIT 7"),
    "o_nulls_first": ("SELECT n_nationkey, nullif(n_regionkey, 2) AS v FROM nation ORDER BY v NULLS FIRST, n_nationkey LIMIT 8", None),
    "o_limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", None),
    "o_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "o_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "o_union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "o_intersect": ("SELECT c_nationkey AS k, c_nationkey + 1 AS j FROM customer INTERSECT SELECT s_nationkey, s_nationkey + 1 FROM supplier", None),
    "o_except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000", None),
    "o_except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    # scalar functions
    "f_math": ("SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS a, round(exp(c_nationkey / 10.0), 6) AS b, round(ln(c_custkey + 1), 6) AS c, round(log2(c_custkey + 1), 6) AS d, round(log(c_custkey + 1), 6) AS e, round(sin(c_acctbal), 6) AS f, round(atan(c_acctbal), 6) AS g, round(radians(c_acctbal), 6) AS h, power(c_nationkey, 2) AS i, round(pi(), 6) AS j, sign(c_acctbal) AS k FROM customer", "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS a, round(exp(c_nationkey / 10.0), 6) AS b, round(ln(c_custkey + 1), 6) AS c, round(log2(c_custkey + 1), 6) AS d, round(log10(c_custkey + 1), 6) AS e, round(sin(c_acctbal), 6) AS f, round(atan(c_acctbal), 6) AS g, round(radians(c_acctbal), 6) AS h, power(c_nationkey, 2)::DOUBLE AS i, round(pi(), 6) AS j, sign(c_acctbal)::DOUBLE AS k FROM customer"),
    "f_rounding": ("SELECT c_custkey, ceil(c_acctbal) AS a, floor(c_acctbal) AS b, trunc(c_acctbal) AS c, mod(c_custkey, 7) AS d, div(c_custkey, 7) AS e, mod(c_custkey, 0) AS f, gcd(c_custkey, 36) AS g, lcm(c_nationkey, 6) AS h, greatest(c_nationkey, 10, NULL) AS i FROM customer", "SELECT c_custkey, ceil(c_acctbal)::DOUBLE AS a, floor(c_acctbal)::DOUBLE AS b, trunc(c_acctbal)::DOUBLE AS c, (c_custkey % 7)::DOUBLE AS d, (c_custkey // 7)::DOUBLE AS e, NULL::DOUBLE AS f, gcd(c_custkey, 36)::BIGINT AS g, lcm(c_nationkey, 6)::BIGINT AS h, greatest(c_nationkey, 10) AS i FROM customer"),
    "f_string": ("SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, length(p_name) AS c, left(p_name, 3) AS d, right(p_name, 3) AS e, lpad(p_brand, 12, '*') AS f, rpad(p_brand, 12, '*') AS g, replace(p_name, 'a', 'A') AS h, reverse(p_name) AS i, repeat('ab', 2) AS j, ascii(p_name) AS k, md5(p_name) AS l, split_part(p_type, ' ', 1) AS m, substr(p_name, 2, 4) AS n, position('a' IN p_name) AS o, find_idx(p_name, 'e') AS p, concat(p_brand, NULL, '-', p_size) AS q, concat_ws('|', p_brand, NULL, 'x') AS r, trim('  x ') AS s, initcap('hello world') AS t, hex(p_size) AS u FROM part", "SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, length(p_name) AS c, left(p_name, 3) AS d, right(p_name, 3) AS e, lpad(p_brand, 12, '*') AS f, rpad(p_brand, 12, '*') AS g, replace(p_name, 'a', 'A') AS h, reverse(p_name) AS i, repeat('ab', 2) AS j, ascii(p_name) AS k, md5(p_name) AS l, split_part(p_type, ' ', 1) AS m, substr(p_name, 2, 4) AS n, position('a' IN p_name) AS o, strpos(p_name, 'e') AS p, concat(p_brand, NULL, '-', p_size) AS q, concat_ws('|', p_brand, NULL, 'x') AS r, trim('  x ') AS s, 'Hello World' AS t, lower(hex(p_size)) AS u FROM part"),
    "f_date": ("SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, add_month(CAST(o_orderdate AS DATE), 1) AS am, last_day(CAST(o_orderdate AS DATE)) AS ld, to_char(o_orderdate, '%Y-%m-%d') AS tc FROM orders", "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS am, last_day(o_orderdate) AS ld, strftime(o_orderdate, '%Y-%m-%d') AS tc FROM orders"),
    "f_format": ("SELECT c_custkey, format('%s:%s%%', c_custkey, c_mktsegment) AS a, to_char(c_custkey, '9,999.00') AS b, to_number('$1,234.50', '9') AS c, to_number('abc', '9') AS d, coalesce(NULL, c_name) AS e, ifnull(NULL, 'z') AS f, nullif(c_nationkey, 1) AS g FROM customer", "SELECT c_custkey, c_custkey || ':' || c_mktsegment || '%' AS a, format('{:,}', c_custkey) || '.00' AS b, 1234.5::DOUBLE AS c, NULL::DOUBLE AS d, c_name AS e, 'z' AS f, nullif(c_nationkey, 1) AS g FROM customer"),
    "f_arrays": ("SELECT vec_id, array_append(array(1, 2), 3) AS a, array_prepend(0, array(1, 2)) AS b, array_slice(array(1, 2, 3, 4), 2, 3) AS c, array_distinct(array(1, 1, 2)) AS d, cardinality(embedding) AS e FROM embeddings", "SELECT vec_id, [1, 2, 3] AS a, [0, 1, 2] AS b, [2, 3] AS c, [1, 2] AS d, len(embedding) AS e FROM embeddings"),
    # JSON text
    "json_get_text": ("SELECT event_id, props ->> 'k' AS k, (props -> 'zzz') ->> 'x' AS none FROM events", "SELECT event_id, props ->> '$.k' AS k, NULL::VARCHAR AS none FROM events"),
    "json_operators": ("SELECT '{\"a\":{\"b\":[1,2,\"x\"]},\"n\":null}' -> 'a' ->> 'b' AS ab, ('{\"n\":null}' ->> 'n') AS n, ('[10,20]' ->> 1) AS i, ('{\"a\":[1,2,3]}' @> '{\"a\":[2]}') AS c, ('{\"a\":1}' <@ '{\"a\":1,\"b\":2}') AS d, jsonb_path_query_first('{\"a\":[{\"b\":1},{\"b\":2}]}', '$.a[*].b') AS p, jsonb_path_query_array('{\"a\":[{\"b\":1},{\"b\":2}]}', '$.a[*].b') AS q", "SELECT '[1,2,\"x\"]' AS ab, 'null' AS n, '20' AS i, true AS c, true AS d, '1' AS p, '[1,2]' AS q"),
    # subqueries, common tables, recursion
    "d_cte": ("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_custkey, n FROM customer JOIN per ON c_custkey = o_custkey", None),
    "d_recursive": ("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS INTEGER) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t"),
    "d_scalar_subquery": ("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)", None),
    "d_derived": ("SELECT g, max(n) AS m FROM (SELECT c_nationkey AS g, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) x GROUP BY g", None),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    named = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    return lambda spark, sf_dir: Engine(spark, sf_dir, named).sql(text)


def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir, ["orders"]).sql("SELECT o_orderkey FROM orders WHERE o_totalprice > $1 AND o_orderstatus = $2 -- $3 is a comment", [150000, "F"])


QUERIES = {name: _query(text) for name, (text, _) in SQL.items()} | {"p_parameters": _parameters}
ORACLE_SQL = {name: duck or text for name, (text, duck) in SQL.items()} | {"p_parameters": "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'"}
