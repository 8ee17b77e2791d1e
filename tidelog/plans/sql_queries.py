"""Delegated SQL: queries that the engine hands to the SQL planner, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.json import register
from ..sources.catalog import Catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    c = Catalog(spark)
    for t in TABLES:
        c.register_file(t, f"{sf_dir}/{t}.parquet")
    return c


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = catalog(spark, sf_dir)
        register(spark)
        return c.sql(text, max_rows=None)

    return run


#: name -> SQL that both dialects read alike.
SAME = {
    "join_inner": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 GROUP BY c_custkey",
    "join_right": "SELECT c_custkey, count(o_orderkey) AS n FROM orders RIGHT JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_full": "SELECT s.s_nationkey AS a, c.c_nationkey AS b, count(*) AS n FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL OUTER JOIN (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey < 20) c ON s_nationkey = c_nationkey GROUP BY 1, 2",
    "join_semi": "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "join_anti": "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)",
    "join_in": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 3)",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_theta": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_using": "SELECT n_nationkey, x.n_name FROM nation x JOIN (SELECT n_nationkey, n_regionkey FROM nation) y USING (n_nationkey, n_regionkey)",
    "join_natural": "SELECT n_nationkey, n_regionkey, n_name FROM nation NATURAL JOIN (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey > 1)",
    "join_star": "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "subquery_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "subquery_correlated": "SELECT l_orderkey, l_linenumber FROM lineitem x WHERE l_quantity > (SELECT 1.5 * avg(y.l_quantity) FROM lineitem y WHERE y.l_partkey = x.l_partkey)",
    "agg_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_distinct": "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, count(DISTINCT c_name) AS names FROM customer GROUP BY c_mktsegment",
    "agg_filter": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, round(sum(value) FILTER (WHERE user_id % 2 = 0), 6) AS even FROM events GROUP BY event_type",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_statistics": "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(stddev_pop(value), 6) AS sdp, round(var_samp(value), 5) AS v, round(median(value), 6) AS med, round(corr(value, user_id), 6) AS c, round(covar_samp(value, user_id), 4) AS cv FROM events GROUP BY event_type",
    "agg_bool_bit": "SELECT event_type, bool_and(value > 0) AS a, bool_or(value > 99) AS o, bit_and(user_id) AS ba, bit_or(user_id) AS bo, bit_xor(user_id) AS bx FROM events GROUP BY event_type",
    "agg_regression": "SELECT round(regr_slope(o_totalprice, o_custkey), 4) AS slope, round(regr_r2(o_totalprice, o_custkey), 6) AS r2, regr_count(o_totalprice, o_custkey) AS n FROM orders",
    "window_rank": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w2 AS rk, dense_rank() OVER w2 AS dr, round(percent_rank() OVER w2, 6) AS pr, round(cume_dist() OVER w2, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), w2 AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "window_lag_lead": "SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_frame_rows": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS s, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS m FROM events",
    "window_frame_range": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS n FROM orders",
    "window_ntile": "SELECT c_custkey, ntile(7) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS bucket FROM customer",
    "window_first_last": "SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 15",
    "order_nulls": "SELECT c_custkey, v FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) t ORDER BY v ASC NULLS LAST, c_custkey LIMIT 1100",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "with_cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), n AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM n JOIN customer ON c_custkey = o_custkey",
    "with_recursive": "WITH RECURSIVE t(i, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, f * (i + 1) FROM t WHERE i < 15) SELECT i, f FROM t",
    "fn_string": "SELECT c_custkey, concat(lower(c_name), '/', upper(c_mktsegment)) AS a, length(c_name) AS n, substr(c_name, 3, 5) AS s, trim('  x ') AS t, replace(c_name, 'Customer', 'C') AS r, lpad(CAST(c_nationkey AS VARCHAR(9)), 4, '0') AS l, reverse(c_mktsegment) AS v, split_part(c_name, '#', 2) AS p, repeat('ab', 2) AS rr, left(c_name, 2) AS le, md5(c_name) AS m, translate(c_mktsegment, 'AEI', 'aei') AS tr, concat_ws('-', c_mktsegment, 'z') AS w FROM customer",
    "fn_math": "SELECT event_id, abs(value - 50) AS a, ceil(value) AS c, floor(value) AS f, round(value, 1) AS r, round(sqrt(abs(value)), 6) AS q, round(exp(value / 100), 6) AS e, round(ln(abs(value) + 1), 6) AS l, round(log10(abs(value) + 1), 6) AS g, round(power(value, 2), 4) AS p, sign(value - 50) AS s, round(degrees(value), 4) AS d, round(sin(value) + cos(value), 6) AS t, greatest(value, 10.0) AS gr, least(value, 90.0) AS le, user_id % 7 AS m FROM events",
    "fn_conditional": "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS a, CASE WHEN value < 25 THEN 'low' WHEN value < 75 THEN 'mid' ELSE 'high' END AS b, CAST(value AS BIGINT) >= 0 AS c FROM events",
    "fn_date": "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(extract(year FROM ts) AS INT) AS y, CAST(extract(month FROM ts) AS INT) AS m, CAST(extract(day FROM ts) AS INT) AS d, CAST(extract(hour FROM ts) AS INT) AS hh, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS dt FROM events",
}
#: name -> (our dialect, DuckDB's).
OWN = {
    "fn_regexp": (
        "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS r, p_type LIKE '%A%' AS l, regexp_count(p_name, '[aeiou]') AS n FROM part WHERE p_name LIKE '%a%'",
        "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') AS r, p_type LIKE '%A%' AS l, len(regexp_extract_all(p_name, '[aeiou]')) AS n FROM part WHERE p_name LIKE '%a%'",
    ),
    "fn_array": (
        "SELECT vec_id, size(embedding) AS n, round(array_max(embedding), 5) AS hi, round(array_min(embedding), 5) AS lo, array_contains(array(1, 2, 3), label) AS c, array_position(array(5, 1, 2), label) AS p, array_join(transform(slice(embedding, 1, 2), x -> cast(floor(x * 10) AS INT)), ',') AS s FROM embeddings",
        "SELECT vec_id, len(embedding) AS n, round(list_max(embedding), 5) AS hi, round(list_min(embedding), 5) AS lo, list_contains([1, 2, 3], label) AS c, coalesce(list_position([5, 1, 2], label), 0) AS p, array_to_string(list_transform(list_slice(embedding, 1, 2), lambda x: CAST(floor(x * 10) AS INT)), ',') AS s FROM embeddings",
    ),
    "fn_map": (
        "SELECT event_id, element_at(map('t', event_type, 'u', cast(user_id AS STRING)), 't') AS t, size(map_keys(map('a', 1, 'b', 2))) AS n, named_struct('x', value).x AS x FROM events",
        "SELECT event_id, MAP {'t': event_type, 'u': CAST(user_id AS VARCHAR)}['t'] AS t, len(map_keys(MAP {'a': 1, 'b': 2})) AS n, {'x': value}.x AS x FROM events",
    ),
    "fn_unnest": (
        "SELECT vec_id, pos, round(x, 5) AS x FROM (SELECT vec_id, posexplode(slice(embedding, 1, 4)) AS (pos, x) FROM embeddings)",
        "SELECT vec_id, i - 1 AS pos, round(embedding[i], 5) AS x FROM embeddings, range(1, 5) t(i)",
    ),
    "fn_aliases": (
        "SELECT event_id, strpos(event_type, 'c') AS p, starts_with(event_type, 'c') AS s, ends_with(event_type, 'k') AS e, to_hex(user_id) AS h, sha256(event_type) AS sh, to_timestamp_millis(event_id * 1000) AS t, date_bin(INTERVAL '15' MINUTE, ts) AS b FROM events",
        "SELECT event_id, strpos(event_type, 'c') AS p, starts_with(event_type, 'c') AS s, ends_with(event_type, 'k') AS e, lower(printf('%x', user_id)) AS h, sha256(event_type) AS sh, make_timestamp(event_id * 1000000) AS t, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS b FROM events",
    ),
    "integer_division": (
        "SELECT event_id, user_id div 7 AS q, pmod(user_id, 7) AS r FROM events",
        "SELECT event_id, user_id // 7 AS q, user_id % 7 AS r FROM events",
    ),
    "agg_approximate": (
        "SELECT abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS near, approx_percentile(o_totalprice, 0.5) > 0 AS positive FROM orders",
        "SELECT true AS near, true AS positive",
    ),
    "agg_collect": (
        "SELECT c_nationkey, array_join(sort_array(collect_set(c_mktsegment)), ',') AS segments, max_by(c_name, struct(c_acctbal, c_custkey)) AS richest FROM customer GROUP BY c_nationkey",
        "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments, arg_max(c_name, {'a': c_acctbal, 'b': c_custkey}) AS richest FROM customer GROUP BY c_nationkey",
    ),
    "window_groups": (
        "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS g FROM orders)",
        "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders",
    ),
}
QUERIES = {name: _query(text) for name, text in SAME.items()} | {name: _query(a) for name, (a, _) in OWN.items()}
ORACLE_SQL = SAME | {name: b for name, (_, b) in OWN.items()}
