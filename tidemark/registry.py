"""Queries by name, over the tables of a folder, each with the SQL that checks it where that differs from its own."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from . import operators
from .plans.lowering import lower

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the folder's tables; only the tables it names are opened."""
    opened: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return opened[name]

    class Schemas(dict):
        def __contains__(self, name: object) -> bool:
            return name in TABLES

        def __getitem__(self, name: str) -> tuple[str, ...]:
            return tuple(table(name).columns)

    return operators.evaluate(lower(sql, Schemas()), table)


class Entry(NamedTuple):
    sql: str
    oracle: str | None = None


# Columns with nulls, made from the tables' own, which hold none.
NULLS = "SELECT o_orderkey, o_custkey, nullif(o_custkey % 5, 0) AS k, o_totalprice, o_orderstatus, o_orderpriority FROM orders"
FEW = "SELECT c_custkey, nullif(c_custkey % 7, 0) AS g, c_nationkey, c_acctbal, CAST(c_custkey % 11 AS INTEGER) AS n FROM customer"
ORDERED_EVENTS = "SELECT event_id, user_id, event_type, CAST(event_id % 13 AS INTEGER) AS s, nullif(CAST(event_id % 5 AS INTEGER), 0) AS x FROM events"

ENTRIES: dict[str, Entry] = {
    # Scan, Filter, Project.
    "scan_all": Entry("SELECT * FROM nation"),
    "filter_range": Entry("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'"),
    "filter_null_3vl": Entry(f"SELECT o_orderkey, k FROM ({NULLS}) t WHERE NOT (k = 2 OR k > 3) OR (k = 1 AND o_custkey > 100)"),
    "filter_like": Entry("SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%S%' AND p_name NOT LIKE 'a%'"),
    "filter_in_list": Entry("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (1, 2, 3)"),
    "filter_any_array": Entry("SELECT c_custkey FROM customer WHERE c_nationkey = ANY('{1,2,3}'::int[])", "SELECT c_custkey FROM customer WHERE c_nationkey = ANY([1, 2, 3])"),
    "filter_all_array": Entry("SELECT c_custkey FROM customer WHERE c_nationkey > ALL(ARRAY[3, 7])", "SELECT c_custkey FROM customer WHERE c_nationkey > 3 AND c_nationkey > 7"),
    "filter_is_distinct": Entry(f"SELECT o_orderkey, k FROM ({NULLS}) t WHERE k IS DISTINCT FROM 3 AND nullif(k, 2) IS NOT DISTINCT FROM nullif(k, 4)"),
    "project_arith": Entry("SELECT l_orderkey, l_linenumber, l_orderkey * 2 + l_linenumber % 3 - 1 AS a, l_orderkey / 7 AS b, -l_linenumber AS c, l_extendedprice * (1 - l_discount) AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey * 2 + l_linenumber % 3 - 1 AS a, l_orderkey // 7 AS b, -l_linenumber AS c, l_extendedprice * (1 - l_discount) AS d FROM lineitem"),
    "project_case": Entry("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE NULL END AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS st FROM orders"),
    "project_cast": Entry("SELECT o_orderkey, CAST(o_custkey AS TEXT) AS t, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS TEXT) AS d, o_orderdate::date::text AS day, CAST('12' AS INTEGER) + 1 AS i, CAST(o_custkey % 2 AS BOOLEAN) AS b FROM orders"),
    "bool_tests": Entry(f"SELECT o_orderkey, (k > 2) IS TRUE AS a, (k > 2) IS NOT TRUE AS b, (k > 2) IS FALSE AS c, (k > 2) IS NOT FALSE AS d, (k > 2) IS UNKNOWN AS e, (k > 2) IS NOT UNKNOWN AS f, k IS NULL AS g FROM ({NULLS}) t", f"SELECT o_orderkey, coalesce(k > 2, false) AS a, NOT coalesce(k > 2, false) AS b, NOT coalesce(k > 2, true) AS c, coalesce(k > 2, true) AS d, (k > 2) IS NULL AS e, (k > 2) IS NOT NULL AS f, k IS NULL AS g FROM ({NULLS}) t"),
    "coalesce_nullif": Entry(f"SELECT o_orderkey, coalesce(k, -1) AS a, nullif(o_orderstatus, 'F') AS b, coalesce(nullif(k, 3), nullif(k, 1), 9) AS c FROM ({NULLS}) t"),
    "collate_c": Entry("SELECT p_partkey FROM part WHERE p_brand COLLATE \"C\" < 'Brand#3'", "SELECT p_partkey FROM part WHERE p_brand < 'Brand#3'"),
    "subquery_from": Entry("SELECT s.n, s.m + 1 AS m FROM (SELECT n_regionkey AS n, n_nationkey * 2 AS m FROM nation WHERE n_nationkey > 3) s WHERE s.m < 40"),
    # Joins.
    "join_inner": Entry("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_inner_composite": Entry("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_linenumber = b.l_linenumber"),
    "join_comma": Entry("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'"),
    "join_theta_range": Entry("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_acctbal BETWEEN n.n_nationkey * 100 AND n.n_nationkey * 100 + 250"),
    "join_cross": Entry("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n"),
    "join_left": Entry("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "join_left_residual": Entry("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 10"),
    "join_right": Entry("SELECT c_custkey, o_orderkey FROM orders RIGHT OUTER JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'F'"),
    "join_full": Entry("SELECT a.k AS ak, b.k AS bk, a.o_orderkey FROM (SELECT o_orderkey, nullif(o_orderkey % 50, 0) AS k FROM orders) a FULL JOIN (SELECT s_suppkey AS k FROM supplier) b ON a.k = b.k"),
    "join_using_full": Entry("SELECT k, a.x, b.y FROM (SELECT c_custkey AS k, c_nationkey AS x FROM customer) a FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS y FROM supplier) b USING (k)"),
    "join_natural": Entry("SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b"),
    "semi_exists": Entry("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)"),
    "semi_exists_uncorrelated": Entry("SELECT r_name FROM region WHERE EXISTS (SELECT * FROM nation WHERE n_nationkey = 3)"),
    "semi_in": Entry("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "semi_in_correlated": Entry("SELECT o_orderkey FROM orders o WHERE o.o_custkey IN (SELECT c.c_custkey FROM customer c WHERE c.c_acctbal * 20 > o.o_totalprice)"),
    "anti_not_exists": Entry("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)"),
    "anti_not_in": Entry(f"SELECT o_orderkey FROM ({NULLS}) t WHERE k NOT IN (SELECT n_regionkey FROM nation WHERE n_regionkey > 2)"),
    "anti_not_in_null": Entry(f"SELECT r_regionkey FROM region WHERE r_regionkey NOT IN (SELECT k FROM ({NULLS}) t)"),
    "anti_not_in_empty": Entry(f"SELECT o_orderkey, k FROM ({NULLS}) t WHERE k NOT IN (SELECT n_regionkey FROM nation WHERE n_regionkey > 99)"),
    "anti_not_in_multi": Entry("SELECT n_nationkey FROM nation WHERE (n_nationkey, n_regionkey) NOT IN (SELECT c_nationkey, nullif(c_nationkey % 5, 1) FROM customer)", "SELECT n_nationkey FROM nation n WHERE NOT EXISTS (SELECT 1 FROM customer WHERE coalesce(n.n_nationkey = c_nationkey AND n.n_regionkey = nullif(c_nationkey % 5, 1), true))"),
    "join_nan_keys": Entry("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN CAST('NaN' AS DOUBLE PRECISION) ELSE CAST(n_nationkey % 3 AS DOUBLE PRECISION) END AS v FROM nation) a JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN CAST('NaN' AS DOUBLE PRECISION) ELSE CAST(n_regionkey AS DOUBLE PRECISION) END AS v FROM nation) b ON a.v = b.v"),
    "join_array_keys": Entry("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON ARRAY[a.n_regionkey, a.n_nationkey % 2] = ARRAY[b.n_regionkey, b.n_nationkey % 3]"),
    "self_join": Entry("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_chain": Entry("SELECT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey WHERE r_name LIKE 'A%'"),
    # Aggregation and DISTINCT.
    "agg_flagship": Entry("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 0) AS sum_disc, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "agg_group_expr": Entry("SELECT o_custkey % 10 AS g, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY o_custkey % 10"),
    "agg_group_alias": Entry("SELECT o_orderstatus AS st, o_custkey % 3 AS g, count(*) AS n FROM orders GROUP BY st, 2"),
    "agg_global": Entry("SELECT count(*) AS n, min(o_orderkey) AS a, max(o_orderkey) AS b, round(avg(o_totalprice), 2) AS c FROM orders"),
    "agg_global_empty": Entry("SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0"),
    "agg_filter": Entry("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 0) AS s, count(*) AS n FROM orders GROUP BY o_orderpriority"),
    "agg_distinct": Entry("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT o_custkey % 100) AS BIGINT) AS s FROM orders GROUP BY o_orderpriority"),
    "agg_distinct_multi": Entry(f"SELECT o_orderstatus, regr_count(DISTINCT k, o_custkey % 20) AS n FROM ({NULLS}) t GROUP BY o_orderstatus", f"SELECT o_orderstatus, count(DISTINCT (k, o_custkey % 20)) FILTER (WHERE k IS NOT NULL) AS n FROM ({NULLS}) t GROUP BY o_orderstatus"),
    "agg_ordered": Entry("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names, array_agg(n_nationkey ORDER BY n_nationkey % 3 DESC, n_nationkey) AS keys, max(n_name ORDER BY n_nationkey) AS m FROM nation GROUP BY n_regionkey"),
    "agg_ordered_filter": Entry("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) FILTER (WHERE n_nationkey > 6) AS names FROM nation GROUP BY n_regionkey"),
    "agg_float_fold": Entry("SELECT event_type, round(sum(value ORDER BY event_id DESC), 2) AS s, round(avg(value ORDER BY event_id) FILTER (WHERE value > 1), 4) AS a FROM events GROUP BY event_type"),
    "agg_having": Entry("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) < 50000"),
    "agg_having_global": Entry("SELECT count(*) AS n FROM orders HAVING count(*) > 5"),
    "agg_minmax": Entry("SELECT p_brand, min(p_name) AS a, max(p_name) AS b, min(p_size) AS c, max(p_retailprice) AS d FROM part GROUP BY p_brand"),
    "agg_stats": Entry("SELECT event_type, round(var_pop(value), 4) AS vp, round(stddev_samp(value), 4) AS sd, round(corr(value, event_id % 100), 4) AS c, round(covar_pop(value, event_id % 100), 3) AS cv, CAST(regr_count(value, event_id) AS BIGINT) AS rc, round(regr_slope(value, event_id % 100), 6) AS rs FROM events GROUP BY event_type"),
    "agg_bool_bit": Entry("SELECT event_type, bool_and(value > 0) AS a, bool_or(user_id % 50 = 7) AS b, bit_or(CAST(user_id % 64 AS INTEGER)) AS c, bit_and(CAST(user_id % 64 + 128 AS INTEGER)) AS d, bit_xor(CAST(user_id % 64 AS INTEGER)) AS e FROM events GROUP BY event_type"),
    "agg_null_group": Entry(f"SELECT k, count(*) AS n, count(k) AS m FROM ({NULLS}) t GROUP BY k"),
    "agg_no_aggregates": Entry("SELECT c_nationkey, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment"),
    "distinct_single": Entry("SELECT DISTINCT o_orderpriority FROM orders"),
    "distinct_multi_null": Entry(f"SELECT DISTINCT k, o_orderstatus FROM ({NULLS}) t"),
    "distinct_over_agg": Entry("SELECT DISTINCT count(*) AS n, c_nationkey % 4 AS g FROM customer GROUP BY c_nationkey"),
    # Windows.
    "win_row_number": Entry(f"SELECT c_custkey, g, row_number() OVER (PARTITION BY g ORDER BY n DESC, c_custkey) AS rn FROM ({FEW}) t"),
    "win_rank_dense": Entry(f"SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d FROM ({FEW}) t WINDOW w AS (PARTITION BY c_nationkey ORDER BY n)"),
    "win_percent_cume": Entry(f"SELECT c_custkey, round(percent_rank() OVER (PARTITION BY g ORDER BY n), 9) AS p, round(cume_dist() OVER (PARTITION BY g ORDER BY n DESC), 9) AS c FROM ({FEW}) t"),
    "win_ntile": Entry(f"SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS t FROM ({FEW}) t"),
    "win_ntile_dynamic": Entry(
        f"SELECT c_custkey, ntile(CASE WHEN c_custkey % 3 = 0 THEN n + 2 END) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS t FROM ({FEW}) t",
        f"""WITH a AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN n + 2 END AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS total FROM ({FEW}) t),
        f AS (SELECT c_nationkey, min(rn) AS first, arg_min(x, rn) AS b FROM a WHERE x IS NOT NULL GROUP BY c_nationkey),
        k AS (SELECT a.c_custkey, a.rn - f.first + 1 AS k, a.total // f.b AS small, a.total % f.b AS extra FROM a LEFT JOIN f USING (c_nationkey))
        SELECT c_custkey, CAST(CASE WHEN k < 1 THEN NULL WHEN k <= extra * (small + 1) THEN (k - 1) // (small + 1) + 1 ELSE extra + (k - extra * (small + 1) - 1) // small + 1 END AS BIGINT) AS t FROM k""",
    ),
    "win_lag_lead": Entry("SELECT event_id, lag(event_id) OVER w AS a, lead(event_type, 2) OVER w AS b, lag(event_id, 1, 0) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)", "SELECT event_id, lag(event_id) OVER w AS a, lead(event_type, 2) OVER w AS b, lag(event_id, 1, 0) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
    "win_lag_dynamic": Entry(
        f"SELECT event_id, lag(event_id, x, -1) OVER (PARTITION BY user_id ORDER BY event_id) AS a, lead(event_type, x) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM ({ORDERED_EVENTS}) t",
        f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ({ORDERED_EVENTS}) t)
        SELECT a.event_id, CASE WHEN a.x IS NULL THEN NULL WHEN b.event_id IS NULL THEN -1 ELSE b.event_id END AS a, c.event_type AS b
        FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.rn = a.rn - a.x LEFT JOIN r c ON a.user_id = c.user_id AND c.rn = a.rn + a.x""",
    ),
    "win_first_last_nth": Entry("SELECT o_orderkey, first_value(o_orderkey) OVER w AS a, last_value(o_orderkey) OVER w AS b, nth_value(o_orderkey, 2) OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"),
    "win_rows_frame": Entry("SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, count(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 5 FOLLOWING AND 9 FOLLOWING) AS n FROM events"),
    "win_empty_frame": Entry("SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 30 PRECEDING AND 20 PRECEDING) AS BIGINT) AS s, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 30 PRECEDING AND 20 PRECEDING) AS n FROM events"),
    "win_range_frame": Entry(f"SELECT c_custkey, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY n) AS BIGINT) AS s, count(*) OVER (PARTITION BY c_nationkey ORDER BY n RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM ({FEW}) t"),
    "win_range_offset": Entry(f"SELECT c_custkey, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY n RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM ({FEW}) t"),
    "win_groups_frame": Entry(f"SELECT c_custkey, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY n GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, max(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY n GROUPS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS m FROM ({FEW}) t"),
    "win_exclude_current": Entry(f"SELECT c_custkey, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s, min(n) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS m, CAST(sum(n) OVER (PARTITION BY c_nationkey ORDER BY n GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS BIGINT) AS g FROM ({FEW}) t"),
    "win_exclude_group": Entry(f"SELECT c_custkey, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY n GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS BIGINT) AS s, count(*) OVER (PARTITION BY c_nationkey ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS c FROM ({FEW}) t"),
    "win_exclude_ties": Entry(f"SELECT c_custkey, max(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY n GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS s, count(*) OVER (PARTITION BY c_nationkey ORDER BY n RANGE UNBOUNDED PRECEDING EXCLUDE TIES) AS c FROM ({FEW}) t"),
    "win_exclude_rows_ties": Entry(
        f"SELECT c_custkey, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY n, g ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE NO OTHERS) AS BIGINT) AS a, count(*) OVER (PARTITION BY c_nationkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS c FROM (SELECT c_custkey, c_nationkey, c_custkey AS n, c_custkey AS g FROM customer) t"
    ),
    "win_exclude_rows_group": Entry(f"SELECT c_custkey, CAST(sum(v) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS BIGINT) AS s FROM (SELECT c_custkey, c_nationkey, n AS v FROM ({FEW}) u) t"),
    "win_nth_dynamic": Entry("SELECT o_orderkey, nth_value(o_totalprice, nullif(o_orderkey % 4, 3) + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS v FROM orders"),
    "win_exclude_values": Entry(f"SELECT c_custkey, first_value(c_custkey) OVER w AS a, last_value(c_custkey) OVER w AS b, nth_value(c_custkey, 3) OVER w AS c FROM ({FEW}) t WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)"),
    "win_exclude_moments": Entry(f"SELECT c_custkey, round(stddev_samp(c_acctbal) OVER w, 4) AS s, round(covar_pop(sqrt(abs(c_acctbal)), n) OVER w, 6) AS v, bit_or(n) OVER w AS b, min(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS m FROM ({FEW}) t WINDOW w AS (PARTITION BY c_nationkey ORDER BY n GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP)"),
    "win_agg_filter": Entry(f"SELECT c_custkey, count(*) FILTER (WHERE n > 4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS a, CAST(sum(n) FILTER (WHERE g = 2) OVER (PARTITION BY c_nationkey) AS BIGINT) AS b FROM ({FEW}) t"),
    "win_multi_clause": Entry(f"SELECT c_custkey, rank() OVER (PARTITION BY g ORDER BY n NULLS FIRST) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS b, count(*) OVER (PARTITION BY g) AS c FROM ({FEW}) t"),
    "win_global": Entry("SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS rn, count(*) OVER () AS n FROM nation"),
    "win_over_agg": Entry("SELECT c_nationkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, c_nationkey) AS r, CAST(sum(count(*)) OVER (ORDER BY c_nationkey) AS BIGINT) AS running FROM customer GROUP BY c_nationkey"),
    "win_nulls_order": Entry(f"SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY g, c_custkey) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY g DESC, c_custkey) AS b FROM ({FEW}) t", f"SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY g ASC NULLS LAST, c_custkey) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY g DESC NULLS FIRST, c_custkey) AS b FROM ({FEW}) t"),
    # Top-N.
    "topn_basic": Entry("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "topn_offset": Entry("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5"),
    "topn_ties": Entry(f"SELECT c_custkey, n FROM ({FEW}) t ORDER BY n DESC FETCH FIRST 3 ROWS WITH TIES", f"SELECT c_custkey, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS rk FROM ({FEW}) t) u WHERE rk <= 3"),
    "topn_ties_offset": Entry(f"SELECT n, g FROM ({FEW}) t ORDER BY g, n OFFSET 4 ROWS FETCH NEXT 9 ROWS WITH TIES", f"SELECT n, g FROM (SELECT *, rank() OVER (ORDER BY g ASC NULLS LAST, n) AS rk, row_number() OVER (ORDER BY g ASC NULLS LAST, n) AS rn FROM ({FEW}) t) u WHERE rk <= 13 AND rn > 4"),
    "topn_nulls_order": Entry(f"SELECT o_orderkey, k FROM ({NULLS}) t ORDER BY k DESC, o_orderkey LIMIT 20", f"SELECT o_orderkey, k FROM ({NULLS}) t ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 20"),
    "topn_limit0": Entry("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0"),
    "topn_over_window": Entry(f"SELECT c_custkey, r FROM (SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY n, c_custkey) AS r FROM ({FEW}) t) u ORDER BY r DESC, c_custkey LIMIT 12"),
    "topn_hidden_key": Entry("SELECT o_orderkey FROM orders ORDER BY o_totalprice * 2 DESC, o_orderkey LIMIT 5"),
    # Chains, set operations and CTEs.
    "chain_join_agg_window_topn": Entry("SELECT r_name, n_name, revenue, rk FROM (SELECT r_name, n_name, revenue, rank() OVER (PARTITION BY r_name ORDER BY revenue DESC, n_name) AS rk FROM (SELECT r_name, n_name, round(sum(o_totalprice), 0) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name) a) b WHERE rk <= 3 ORDER BY r_name, rk LIMIT 10"),
    "set_union": Entry("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier"),
    "set_union_all": Entry("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier"),
    "set_intersect_all": Entry("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier"),
    "set_except_all": Entry("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier"),
    "cte_basic": Entry("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10) SELECT c_name, n FROM big JOIN customer ON c_custkey = o_custkey"),
    # Families of functions.
    "str_funcs": Entry("SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, length(p_name) AS c, substring(p_name, 2, 3) AS d, trim('  x ') AS e, replace(p_type, 'A', '_') AS f, p_brand || '-' || p_type AS g, position('#' IN p_brand) AS h, left(p_name, 2) AS i, right(p_name, 2) AS j, lpad(p_brand, 12, '*') AS k, reverse(p_brand) AS l, split_part(p_brand, '#', 2) AS m, md5(p_name) AS n, p_name ~ '^[a-m]' AS o FROM part", "SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, CAST(length(p_name) AS INTEGER) AS c, substring(p_name, 2, 3) AS d, trim('  x ') AS e, replace(p_type, 'A', '_') AS f, p_brand || '-' || p_type AS g, CAST(instr(p_brand, '#') AS INTEGER) AS h, left(p_name, 2) AS i, right(p_name, 2) AS j, lpad(p_brand, 12, '*') AS k, reverse(p_brand) AS l, split_part(p_brand, '#', 2) AS m, md5(p_name) AS n, regexp_matches(p_name, '^[a-m]') AS o FROM part"),
    "math_funcs": Entry("SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal) AS b, floor(s_acctbal) AS c, round(s_acctbal, 1) AS d, round(sqrt(abs(s_acctbal)), 6) AS e, round(power(s_suppkey, 2), 1) AS f, round(ln(s_suppkey + 1), 9) AS g, mod(s_suppkey, 7) AS h, sign(s_acctbal) AS i, round(exp(s_suppkey % 5), 6) AS j FROM supplier", "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS b, CAST(floor(s_acctbal) AS BIGINT) AS c, round(s_acctbal, 1) AS d, round(sqrt(abs(s_acctbal)), 6) AS e, round(power(s_suppkey, 2), 1) AS f, round(ln(s_suppkey + 1), 9) AS g, mod(s_suppkey, 7) AS h, CAST(sign(s_acctbal) AS DOUBLE) AS i, round(exp(s_suppkey % 5), 6) AS j FROM supplier"),
    "date_funcs": Entry("SELECT o_orderkey, date_trunc('month', o_orderdate) AS a, extract(year FROM o_orderdate) AS b, extract(month FROM o_orderdate) AS c, extract(dow FROM o_orderdate) AS d, CAST(CAST(o_orderdate AS DATE) + 3 AS TEXT) AS e, o_orderdate + INTERVAL '2 days' AS f FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS a, CAST(extract(year FROM o_orderdate) AS INTEGER) AS b, CAST(extract(month FROM o_orderdate) AS INTEGER) AS c, CAST(extract(dow FROM o_orderdate) AS INTEGER) AS d, CAST(CAST(o_orderdate AS DATE) + 3 AS TEXT) AS e, o_orderdate + INTERVAL '2 days' AS f FROM orders"),
    "array_funcs": Entry("SELECT n_nationkey, cardinality(ARRAY[n_nationkey, 1]) AS a, array_position(ARRAY[5, 6, 7], n_regionkey + 4) AS b, ARRAY[1, n_regionkey] @> ARRAY[n_regionkey] AS c, array_append(ARRAY[n_nationkey], 9) AS d FROM nation", "SELECT n_nationkey, 2 AS a, CAST(CASE WHEN n_regionkey + 4 IN (5, 6, 7) THEN n_regionkey ELSE 0 END AS BIGINT) AS b, true AS c, [n_nationkey, 9] AS d FROM nation"),
    "json_funcs": Entry("SELECT event_id, props ->> 'k' AS a, jsonb_extract_path_text(props, 'k') AS b, props ->> 'missing' AS c FROM events", "SELECT event_id, props ->> '$.k' AS a, props ->> '$.k' AS b, props ->> '$.missing' AS c FROM events"),
}


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, sf_dir, sql)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(e.sql) for name, e in ENTRIES.items()}
ORACLE: dict[str, str] = {name: e.oracle or e.sql for name, e in ENTRIES.items()}
