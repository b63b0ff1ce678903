"""The SQL surface on the star schema: one query for each kind of operator that free SQL over the lake can reach.

Where both dialects agree, one text serves Spark and the independent engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, spark_sql: str, other: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in spark_sql:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(spark_sql)

    QUERIES[name] = run
    SQL[name] = other or spark_sql


_MONEY = "CAST(round(sum({0}), 2) AS DOUBLE)"

_register("sql_filter_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_discount >= 0.05 AND l_returnflag IN ('A', 'R')")
_register("sql_inner_join", f"SELECT n_name, {_MONEY.format('o_totalprice')} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_register("sql_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_register("sql_full_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) b ON a.k = b.k")
_register("sql_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
_register("sql_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_register("sql_cross_join", "SELECT r_name, e.event_type FROM region CROSS JOIN (SELECT DISTINCT event_type FROM events) e")
_register("sql_theta_join", "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_register("sql_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_register("sql_approximate_distinct", "SELECT event_type, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.15 * count(DISTINCT user_id) AS near FROM events GROUP BY event_type")
_register("sql_distinct_aggregates", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type")
_G = "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, CAST(grouping(l_returnflag) AS INTEGER) AS g1, CAST(grouping(l_linestatus) AS INTEGER) AS g2 FROM lineitem GROUP BY "
_register("sql_rollup", _G + "ROLLUP (l_returnflag, l_linestatus)")
_register("sql_cube", _G + "CUBE (l_returnflag, l_linestatus)")
_register("sql_grouping_sets", _G + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_register("sql_ranking", "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS t FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate)")
_register("sql_analytic", "SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2) OVER w AS after, first_value(value) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
_register("sql_running_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM events")
_register("sql_top_k", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) x WHERE k <= 2")
_register("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_register("sql_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
_register("sql_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
_register("sql_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
_register("sql_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders")
_register("sql_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)")
_register("sql_correlated_subquery", "SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer")
_register("sql_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big JOIN top ON n >= m - 2")
_register("sql_recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 40) SELECT n, f FROM t")
_register("sql_quantiles", "SELECT o_orderpriority, round(percentile(o_totalprice, 0.5), 4) AS median, round(percentile(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority")
_register("sql_pivot", "SELECT l_returnflag, " + ", ".join(f"count(CASE WHEN l_linestatus = '{s}' THEN 1 END) AS status_{s.lower()}" for s in "OF") + " FROM lineitem GROUP BY l_returnflag")
_register("sql_conditional", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status FROM orders")
_register("sql_strings", "SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, length(c_name) AS n, substr(c_name, 1, 8) AS head, replace(c_name, '#', '-') AS swapped, trim(concat(' ', c_name, ' ')) AS trimmed, CAST(c_name LIKE '%1%' AS INTEGER) AS has_one FROM customer")
_register("sql_regex", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '') AS digits FROM customer WHERE c_name RLIKE '[05]$'", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer WHERE regexp_matches(c_name, '[05]$')")
_register("sql_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, date_format(o_orderdate, 'yyyy-MM-dd') AS d, o_orderdate + INTERVAL 45 DAY AS due FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderdate + INTERVAL 45 DAY AS due FROM orders")
_register("sql_math", "SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) AS l, round(sqrt(l_quantity), 6) AS s, round(power(1 + l_tax, 3), 6) AS p, abs(l_discount - 0.05) AS a, greatest(l_tax, l_discount) AS g FROM lineitem")
_register("sql_hashes", "SELECT n_nationkey, substr(sha2(n_name, 256), 1, 16) AS sha, md5(n_name) AS md FROM nation", "SELECT n_nationkey, substr(sha256(n_name), 1, 16) AS sha, md5(n_name) AS md FROM nation")
_register("json_props", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
_register("sql_lists", "SELECT vec_id, size(embedding) AS n, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), 0D, (a, x) -> a + x), 4) AS norm2 FROM embeddings", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm2 FROM embeddings")
_register("sql_tumbling_window", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type")
_register("sql_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '1' HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session")
