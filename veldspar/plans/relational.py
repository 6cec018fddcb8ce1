"""REL rows: what Spark SQL itself gives, run through the engine's session as SQL over the same tables.

Each text runs on Spark and, with the few changes listed beside it, on DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldspar.engine import Engine

from ._base import Query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _run(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine.over(spark, sf_dir, TABLES).sql(sql)

    return run


def _both(sql: str, other: str | None = None) -> Query:
    return _run(sql), other or sql


def R(x: str, d: int = 2) -> str:
    return f"floor(({x}) * 1e{d} + 5e-1) / 1e{d}"


QUERIES: dict[str, Query] = {
    "REL01_projection": _both("SELECT o_orderkey, o_custkey * 2 + 1 AS k, CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS size_class FROM orders"),
    "REL02_filter": _both("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type IN ('ECONOMY', 'STANDARD') AND p_name LIKE '%ring%' AND p_brand IS NOT NULL"),
    "REL03_joins": _both("SELECT c.c_custkey, n.n_name, o.o_orderkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000"),
    "REL03_full_join": _both("SELECT a.k AS ak, b.k AS bk FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey < 15) a FULL OUTER JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey > 5) b ON a.k = b.k"),
    "REL04_cross_join": _both("SELECT r.r_regionkey, n.n_nationkey FROM region r CROSS JOIN nation n"),
    "REL05_range_join": _both("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND b.s_acctbal < a.s_acctbal + 100"),
    "REL06_semi_anti": _both("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_p FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)"),
    "REL07_aggregate": _both(f"SELECT l_returnflag, l_linestatus, {R('sum(l_quantity)')} AS qty, {R('sum(l_extendedprice * (1 - l_discount))')} AS revenue, count(*) AS n, min(l_tax) AS low, max(l_tax) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "REL08_distinct": _both("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders) x GROUP BY o_orderstatus"),
    "REL09_having": _both("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    "REL10_grouping_sets": _both("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"),
    "REL10_cube": _both("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "REL11_median": _both(f"SELECT o_orderstatus, {R('median(o_totalprice)')} AS mid FROM orders GROUP BY o_orderstatus"),
    "REL12_statistics": _both(f"SELECT event_type, {R('stddev_samp(value)', 4)} AS sd, {R('var_pop(value)', 4)} AS vp, {R('corr(value, user_id)', 4)} AS co, {R('covar_pop(value, user_id)', 4)} AS cp FROM events GROUP BY event_type"),
    "REL13_ranking": _both(f"SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS q, {R('percent_rank() OVER w', 6)} AS pr, {R('cume_dist() OVER w', 6)} AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"),
    "REL14_analytic": _both("SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2) OVER w AS later, first_value(value) OVER w AS first, nth_value(value, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
    "REL15_frames": _both(f"SELECT event_id, {R('sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)')} AS near, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS recent FROM events"),
    "REL16_top_k": _both("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5"),
    "REL17_set_operations": _both("(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)"),
    "REL18_subqueries": _both("WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n, top FROM customer c JOIN big ON o_custkey = c_custkey WHERE top > (SELECT avg(o_totalprice) FROM orders)"),
    "REL18_lateral": _both("SELECT n_nationkey, s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 3000) x"),
    "REL19_recursive": _both("WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 15) SELECT n, f FROM t"),
    "REL22_strings": _both("SELECT p_partkey, concat(upper(p_name), '-', p_brand) AS a, substr(p_name, 2, 3) AS b, length(trim(p_name)) AS c, lpad(p_brand, 12, '*') AS d, replace(p_type, 'E', 'e') AS e, position('i' IN p_name) AS f, split_part(p_name, ' ', 2) AS g FROM part"),
    "REL23_regex": (_run("SELECT p_partkey, p_name RLIKE '^s.*g$' AS m, regexp_replace(p_name, '[aeiou]', '_') AS r, p_name ILIKE 'SMALL%' AS i FROM part"), "SELECT p_partkey, regexp_matches(p_name, '^s.*g$') AS m, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, p_name ILIKE 'SMALL%' AS i FROM part"),
    "REL24_math": _both(f"SELECT event_id, {R('sqrt(value)', 6)} AS a, {R('ln(value + 1)', 6)} AS b, {R('exp(value / 1000)', 6)} AS c, {R('power(value, 1.5)', 2)} AS d, {R('sin(value)', 6)} AS e, CAST(sign(value - 50) AS DOUBLE) AS f, CAST(ceil(value) AS BIGINT) AS g FROM events"),
    "REL25_dates": _both("SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS m, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR(10)) AS first, CAST(CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS VARCHAR(10)) AS later FROM orders"),
    "REL26_arrays": (_run("SELECT o_custkey, size(array_agg(o_orderkey)) AS n, array_join(slice(sort_array(array_agg(o_orderkey)), 1, 3), ',') AS first, array_contains(array_agg(o_orderstatus), 'P') AS p FROM orders GROUP BY o_custkey"), "SELECT o_custkey, len(list(o_orderkey))::INT AS n, array_to_string(list_sort(list(o_orderkey))[1:3], ',') AS first, list_contains(list(o_orderstatus), 'P') AS p FROM orders GROUP BY o_custkey"),
    "REL27_maps": (_run("SELECT s_suppkey, element_at(map('a', s_nationkey, 'b', 7), 'a') AS v, named_struct('x', s_acctbal).x AS w FROM supplier"), "SELECT s_suppkey, s_nationkey AS v, s_acctbal AS w FROM supplier"),
    "REL28_conditional": _both("SELECT p_partkey, coalesce(nullif(p_size, 5), -1) AS a, greatest(p_size, 25) AS b, least(p_size, 25) AS c FROM part"),
    "REL29_hashing": (_run("SELECT p_partkey, md5(p_name) AS m, sha2(p_name, 256) AS s FROM part"), "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s FROM part"),
    "REL30_json": (_run("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events"), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "REL31_casts": _both("SELECT event_id, CAST(value AS INT) >= 0 AS ok, try_cast(event_type AS INT) AS none, CAST(event_id AS VARCHAR(20)) AS text FROM events WHERE value = floor(value)"),
    "REL32_values": (_run("SELECT k, explode(sequence(1, k)) AS i FROM VALUES (1), (2), (4) AS t(k)"), "SELECT k, unnest(range(1, k + 1))::INT AS i FROM (VALUES (1), (2), (4)) t(k)"),
}
