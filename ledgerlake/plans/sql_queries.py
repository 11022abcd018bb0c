"""Queries given as SQL text: they run through the read-only guard. A pair is (Spark, DuckDB) where dialects differ."""

from __future__ import annotations

Y97 = "o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00'"

SQL: dict[str, str | tuple[str, str]] = {
    # joins
    "join_inner": "SELECT n_name, COUNT(*) AS n_customers, ROUND(SUM(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_fact_child": "SELECT o_orderpriority, COUNT(*) AS n_lines, ROUND(SUM(l_extendedprice), 2) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority",
    "join_left": "SELECT c_mktsegment, COUNT(DISTINCT c_custkey) AS n_customers, COUNT(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "join_right": "SELECT COUNT(*) AS n_rows, COUNT(c_custkey) AS n_matched FROM customer RIGHT JOIN supplier ON c_custkey = s_suppkey * 7",
    "join_full": "SELECT COUNT(*) AS n_rows, COUNT(c_custkey) AS n_left, COUNT(s_suppkey) AS n_right FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 31",
    "join_theta": "SELECT r_name, COUNT(*) AS n_pairs FROM region JOIN nation a ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_regionkey = r_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY r_name",
    "semi_join": f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {Y97})",
    "anti_missing": f"SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {Y97})",
    "where_not_exists": "SELECT 99 AS n_nationkey, 'NEW' AS n_name WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 99)",
    "holdings_lookup": "SELECT s_suppkey, s_name, COUNT(*) AS n_lines, ROUND(SUM(l_extendedprice), 2) AS value FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE lower(p_name) LIKE '%widget%' GROUP BY s_suppkey, s_name",
    # sets
    "set_except": f"SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE {Y97}",
    "set_intersect": f"SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE {Y97}",
    "union_all": "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region",
    "union_distinct": "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier",
    "distinct_rows": "SELECT DISTINCT p_brand, p_type FROM part",
    "recursive_cte": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    # aggregates
    "data_status": "SELECT COUNT(DISTINCT o_custkey) AS n_entities, CAST(CAST(MAX(o_orderdate) AS DATE) AS STRING) AS last_date FROM orders WHERE o_orderstatus <> 'X'",
    "max_or_zero": "SELECT COALESCE(MAX(o_orderkey), 0) AS last_key FROM orders WHERE o_custkey = -1",
    "count_filtered": "SELECT COUNT(*) AS n FROM part WHERE p_name NOT LIKE '%ring%' AND p_size > 10",
    "conditional_sum": "SELECT l_returnflag, ROUND(SUM(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END), 2) AS discounted, ROUND(SUM(l_quantity) FILTER (WHERE l_tax = 0), 2) AS untaxed FROM lineitem GROUP BY l_returnflag",
    "group_having": "SELECT p_type, COUNT(*) AS n, ROUND(AVG(p_retailprice), 4) AS mean_price FROM part GROUP BY p_type HAVING COUNT(*) > 10",
    "having_min": "SELECT event_type FROM events GROUP BY event_type HAVING COUNT(*) >= 5",
    "min_count_check": "SELECT o_custkey, COUNT(*) AS n, CASE WHEN COUNT(*) >= CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 5 END THEN 1 ELSE 0 END AS ok FROM orders GROUP BY o_custkey",
    "text_len_sum": "SELECT lang, CAST(SUM(LENGTH(text)) AS BIGINT) AS n_chars FROM documents GROUP BY lang",
    "string_agg": (
        "SELECT r_name, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        "SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "rollup_ext": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "share_sum_check": "SELECT s, CASE WHEN ABS(SUM(w) - 100) > 1.0 THEN 0 ELSE 1 END AS ok FROM (SELECT l_suppkey AS s, l_extendedprice * 100 / SUM(l_extendedprice) OVER (PARTITION BY l_suppkey) AS w FROM lineitem) t GROUP BY s",
    # order and limits
    "rank_desc": "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 10",
    "rank_asc_nulls": "SELECT s_suppkey, NULLIF(s_nationkey, 3) AS nationkey FROM supplier ORDER BY nationkey ASC NULLS FIRST, s_suppkey LIMIT 20",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20",
    # windows
    "window_rank": "SELECT o_custkey, o_orderkey, RANK() OVER w AS r, DENSE_RANK() OVER w AS dr, NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "window_lag": "SELECT o_custkey, o_orderkey, ROUND(o_totalprice - LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS change FROM orders",
    "window_frame": "SELECT event_id, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS mean7 FROM events",
    # values
    "safe_div": "SELECT p_partkey, ROUND(p_retailprice / NULLIF(p_size % 5, 0), 4) AS ratio FROM part",
    "int_div": ("SELECT p_partkey, CAST(p_size div 7 AS BIGINT) AS weeks FROM part", "SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS weeks FROM part"),
    "try_cast_default": "SELECT p_partkey, COALESCE(TRY_CAST(substring(p_brand, 7) AS DOUBLE), 0) AS brand_number, COALESCE(TRY_CAST(p_name AS DOUBLE), 0) AS name_number FROM part",
    "null_funcs": "SELECT p_partkey, COALESCE(NULLIF(p_type, 'ECONOMY'), 'none') AS kind, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS band FROM part",
    "regex_filter": ("SELECT p_partkey, p_brand FROM part WHERE p_brand RLIKE '^Brand#1[0-9]?$'", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^Brand#1[0-9]?$')"),
    "range_guard": ("SELECT l_suppkey, COUNT(*) AS n FROM lineitem WHERE l_quantity BETWEEN -25 AND 105 AND l_returnflag RLIKE '[A-Za-z]' GROUP BY l_suppkey", "SELECT l_suppkey, COUNT(*) AS n FROM lineitem WHERE l_quantity BETWEEN -25 AND 105 AND regexp_matches(l_returnflag, '[A-Za-z]') GROUP BY l_suppkey"),
    "band_filter": "SELECT event_id, value FROM events WHERE value >= 10 AND value < 12",
    "like_ci": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDGET%'",
    "month_trunc": ("SELECT date_format(o_orderdate, 'yyyy-MM') AS month, COUNT(*) AS n FROM orders GROUP BY 1", "SELECT strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n FROM orders GROUP BY 1"),
    "date_order_check": ("SELECT COUNT(*) AS n, SUM(CASE WHEN l_shipdate < o_orderdate THEN 1 ELSE 0 END) AS n_early, MAX(CAST(datediff(l_shipdate, o_orderdate) AS BIGINT)) AS longest FROM orders JOIN lineitem ON o_orderkey = l_orderkey", "SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN l_shipdate < o_orderdate THEN 1 ELSE 0 END) AS BIGINT) AS n_early, MAX(datediff('day', o_orderdate, l_shipdate)) AS longest FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    # JSON
    "json_extract": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "json_explode": ("SELECT event_type, key, COUNT(*) AS n, SUM(v) AS total FROM (SELECT event_type, explode(from_json(props, 'map<string,bigint>')) AS (key, v) FROM events) t GROUP BY event_type, key", "SELECT event_type, key, COUNT(*) AS n, CAST(SUM(CAST(json_extract_string(props, '$.' || key) AS BIGINT)) AS BIGINT) AS total FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) t GROUP BY event_type, key"),
    "pivot_matrix": (
        "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (ROUND(SUM(l_quantity), 2) FOR l_linestatus IN ('O' AS open, 'F' AS filled))",
        "SELECT l_returnflag, ROUND(SUM(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS open, ROUND(SUM(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS filled FROM lineitem GROUP BY l_returnflag",
    ),
    "unpivot_periods": (
        "SELECT o_custkey, period, amount FROM (SELECT o_custkey, ROUND(MIN(o_totalprice), 2) AS least, ROUND(MAX(o_totalprice), 2) AS most, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) UNPIVOT (amount FOR period IN (least, most, total))",
        "SELECT o_custkey, period, amount FROM (SELECT o_custkey, ROUND(MIN(o_totalprice), 2) AS least, ROUND(MAX(o_totalprice), 2) AS most, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) UNPIVOT (amount FOR period IN (least, most, total))",
    ),
    "julian_day": (
        "SELECT o_orderkey, datediff(to_date(o_orderdate), DATE '1970-01-01') + 2440587.5D AS julian, CAST(to_date(o_orderdate) AS STRING) AS day, date_format(o_orderdate, 'dd.MM.yyyy') AS shown FROM orders",
        "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440587.5::DOUBLE AS julian, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, strftime(o_orderdate, '%d.%m.%Y') AS shown FROM orders",
    ),
    "lower_unicode": "SELECT p_partkey, lower(concat('ÄÖÉ Ñ ', p_name, ' ', p_brand)) AS low, upper(concat('äöé ñ ', p_name)) AS up FROM part",
    "json_encode": (
        "SELECT o_orderkey, to_json(named_struct('key', o_orderkey, 'day', to_date(o_orderdate), 'status', array(o_orderstatus), 'none', CAST(NULL AS INT))) AS js FROM orders",
        "SELECT o_orderkey, '{\"key\":' || o_orderkey || ',\"day\":\"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '\",\"status\":[\"' || o_orderstatus || '\"]}' AS js FROM orders",
    ),
    # a query that names the join graph, as callers write it
    "sql_passthrough_agg": "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "sql_passthrough_join": "SELECT r_name, COUNT(DISTINCT c_custkey) AS n_customers, ROUND(SUM(o_totalprice), 2) AS spent FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name",
    "sql_passthrough_subquery": "SELECT p_type, COUNT(*) AS n FROM part p WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part q WHERE q.p_type = p.p_type) GROUP BY p_type",
}
