"""Queries whose text is SQL: {table} stands for a driver table in both dialects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import relational as R
from tarn.registry import Query, query, table

#: name -> SQL for both, or (Spark SQL, oracle SQL) where the dialects differ.
SQL: dict[str, str | tuple[str, str]] = {
    # -- filters and predicates
    "filter_comparisons": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity >= 45 AND l_discount < 0.05 AND l_returnflag <> 'N' AND l_tax <= 0.02",
    "filter_three_valued": "SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity > 25 THEN l_tax END > 0.04) IS NOT TRUE AS not_true, (CASE WHEN l_quantity > 25 THEN l_tax END > 0.04) IS NULL AS unknown FROM {lineitem}",
    "filter_in_lists": "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')",
    "filter_in_list_with_null": "SELECT count(*) AS n FROM {orders} WHERE o_orderstatus NOT IN ('F', NULL)",
    "filter_like_prefix": "SELECT p_partkey, p_name FROM {part} WHERE p_brand LIKE 'Brand#1%' AND p_type LIKE '%E%'",
    "filter_date_bounds": "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01 00:00:00'",
    "filter_between_or": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_quantity BETWEEN 1 AND 3 AND l_linestatus = 'O') OR (l_quantity > 49 AND NOT (l_linestatus = 'F'))",
    "project_case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM {orders}",
    "project_case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM {orders}",
    "project_arithmetic": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS charge, l_orderkey % 7 AS r FROM {lineitem}",
    "project_integer_division": ("SELECT o_orderkey, CAST(o_orderkey div 7 AS BIGINT) AS q, CAST(-o_orderkey div 7 AS BIGINT) AS nq FROM {orders}", "SELECT o_orderkey, CAST(o_orderkey // 7 AS BIGINT) AS q, CAST(-(o_orderkey // 7) AS BIGINT) AS nq FROM {orders}"),
    "project_text_functions": ("SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, char_length(c_name) AS n, reverse(c_name) AS back, replace(c_name, '#', '-') AS swapped, ascii(c_mktsegment) AS code, repeat(c_mktsegment, 2) AS twice, substring(c_name, 3, 4) AS part, rtrim(concat(c_name, '  ')) AS trimmed, startswith(c_name, 'Cust') AS starts FROM {customer}", "SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, CAST(length(c_name) AS INTEGER) AS n, reverse(c_name) AS back, replace(c_name, '#', '-') AS swapped, ascii(c_mktsegment) AS code, repeat(c_mktsegment, 2) AS twice, substring(c_name, 3, 4) AS part, rtrim(concat(c_name, '  ')) AS trimmed, starts_with(c_name, 'Cust') AS starts FROM {customer}"),
    "project_null_functions": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s, greatest(o_orderkey, o_custkey, 500) AS g, least(o_orderkey, o_custkey) AS l, abs(o_custkey - o_orderkey) AS d FROM {orders}",
    "project_casts": "SELECT p_partkey, CAST(p_size AS BIGINT) AS big, CAST(p_size AS DOUBLE) AS dbl, CAST(p_size AS DECIMAL(10,0)) AS dec, CAST(p_partkey AS VARCHAR(20)) AS txt FROM {part}",
    "project_conditional_aggregate_pivot": "SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open_lines, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS final_lines FROM {lineitem} GROUP BY l_returnflag",
    # -- joins
    "join_inner": "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_acctbal > 0",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "join_right": "SELECT c_custkey, o_orderkey FROM (SELECT * FROM {orders} WHERE o_totalprice > 300000) o RIGHT JOIN {customer} ON o_custkey = c_custkey",
    "join_full": "SELECT coalesce(a.k, b.k) AS k, a.n AS an, b.n AS bn FROM (SELECT o_custkey AS k, count(*) AS n FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM {orders} WHERE o_orderstatus = 'P' GROUP BY o_custkey) b ON a.k = b.k",
    "join_multi_key": "SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber",
    "join_residual": "SELECT o_orderkey, l_linenumber FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_quantity > 40",
    "join_semi_exists": "SELECT o_orderkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')",
    "join_semi_in": "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 250000)",
    "join_semi_keyless": "SELECT r_regionkey FROM {region} WHERE EXISTS (SELECT 1 FROM {nation} WHERE n_name LIKE 'A%' OR n_nationkey >= 0)",
    "join_anti_not_exists": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "join_anti_not_in": "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_custkey IS NOT NULL AND o_totalprice > 250000)",
    "join_anti_not_in_null": "SELECT count(*) AS n FROM {customer} WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM {orders} UNION ALL SELECT NULL)",
    "join_anti_not_in_empty": "SELECT count(*) AS n FROM {customer} WHERE nullif(c_custkey, 1) NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice < 0)",
    "join_mark": "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000) OR c_acctbal < 0",
    "join_mark_not_in": "SELECT s_suppkey FROM {supplier} WHERE s_suppkey NOT IN (SELECT l_suppkey FROM {lineitem} WHERE l_quantity > 49 AND l_discount > 0.08) OR s_acctbal > 9000",
    "join_scalar_subquery": "SELECT p_partkey FROM {part} p WHERE p_retailprice > (SELECT 0.9 * max(q.p_retailprice) FROM {part} q WHERE q.p_brand = p.p_brand)",
    "join_scalar_count": "SELECT c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS n FROM {customer} c",
    "join_uncorrelated_scalar": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(CAST(o_totalprice AS DECIMAL(18,2))) FROM {orders}) AND o_orderstatus = 'O'",
    "join_lateral": "SELECT n_nationkey, t.n AS n, t.top AS top FROM {nation}, LATERAL (SELECT count(*) AS n, max(c_acctbal) AS top FROM {customer} WHERE c_nationkey = n_nationkey) t",
    "join_self": "SELECT a.c_custkey AS a, b.c_custkey AS b FROM {customer} a JOIN {customer} b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey",
    "join_five_way": "SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey WHERE c_nationkey = s_nationkey GROUP BY n_name",
    "join_theta": "SELECT s_suppkey, c_custkey FROM {supplier} JOIN {customer} ON s_acctbal > c_acctbal + 9500 AND s_nationkey <> c_nationkey",
    "join_cross": "SELECT r_name, s_suppkey FROM {region} CROSS JOIN {supplier}",
    "join_null_keys": "SELECT count(*) AS n FROM (SELECT nullif(o_custkey, 2) AS k FROM {orders}) a JOIN (SELECT nullif(c_custkey, 2) AS k FROM {customer}) b ON a.k = b.k",
    # -- aggregation
    "agg_counts": "SELECT o_orderstatus, count(*) AS n, count(nullif(o_orderpriority, '5-LOW')) AS not_low, count(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY o_orderstatus",
    "agg_min_max": "SELECT l_returnflag, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, min(l_quantity) AS lo, max(l_extendedprice) AS hi, min(l_linestatus) AS s FROM {lineitem} GROUP BY l_returnflag",
    "agg_sum_bigint_exact": ("SELECT CAST(sum(CAST(o_orderkey * 1000003 AS DECIMAL(38,0))) AS STRING) AS total FROM {orders}", "SELECT CAST(sum(o_orderkey::HUGEINT * 1000003) AS VARCHAR) AS total FROM {orders}"),
    "agg_avg": "SELECT l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity) AS mean_qty, avg(l_linenumber) AS mean_line FROM {lineitem} GROUP BY l_linestatus",
    "agg_variance": "SELECT l_returnflag, round(var_samp(l_linenumber), 9) AS vs, round(var_pop(l_linenumber), 9) AS vp, round(stddev_samp(l_linenumber), 9) AS ss, round(stddev_pop(l_linenumber), 9) AS sp FROM {lineitem} GROUP BY l_returnflag",
    "agg_bool": "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS all_large, bool_or(o_totalprice > 400000) AS any_huge FROM {orders} GROUP BY o_orderstatus",
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, CAST(sum(o_custkey) FILTER (WHERE o_totalprice > 100000) AS BIGINT) AS s FROM {orders} GROUP BY o_orderpriority",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM {lineitem} GROUP BY l_returnflag",
    "agg_string_agg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM {nation} GROUP BY n_regionkey"),
    "agg_group_expression": "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, o_orderkey % 3 AS m, count(*) AS n FROM {orders} GROUP BY year(o_orderdate), o_orderkey % 3",
    "agg_having": "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND sum(CAST(o_totalprice AS DECIMAL(18,2))) / count(*) > 100000",
    "agg_empty_input": "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, min(o_orderdate) AS d, max(o_orderstatus) AS t FROM {orders} WHERE o_totalprice < 0",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS BIGINT) AS g FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT n_regionkey, c_mktsegment, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_regionkey), (c_mktsegment), ())",
    "agg_percentile": ("SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med, mode(l_linenumber, true) AS common FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med, (SELECT l_linenumber FROM {lineitem} b WHERE b.l_returnflag = a.l_returnflag GROUP BY l_linenumber ORDER BY count(*) DESC, l_linenumber LIMIT 1) AS common FROM {lineitem} a GROUP BY l_returnflag"),
    "agg_metadata_count": "SELECT count(*) AS n FROM {lineitem}",
    # -- distinct, sort, limit
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}",
    "distinct_nan_zero": (
        "SELECT count(*) AS n, CAST(sum(CASE WHEN isnan(z) THEN 1 ELSE 0 END) AS BIGINT) AS nans FROM (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 0.0D WHEN 1 THEN -0.0D WHEN 2 THEN double('NaN') ELSE double(o_custkey % 3) END AS z FROM {orders}) t",
        "SELECT count(*) AS n, CAST(sum(CASE WHEN isnan(z) THEN 1 ELSE 0 END) AS BIGINT) AS nans FROM (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN -(0.0::DOUBLE) WHEN 2 THEN 'NaN'::DOUBLE ELSE (o_custkey % 3)::DOUBLE END AS z FROM {orders}) t",
    ),
    "filter_nan_comparison": (
        "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN double('NaN') ELSE o_totalprice END AS z FROM {orders}) t WHERE z > 250000D OR z = double('NaN')",
        "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS z FROM {orders}) t WHERE z > 250000 OR z = 'NaN'::DOUBLE",
    ),
    "agg_sum_avg_float": "SELECT l_returnflag, round(sum(l_quantity), 3) AS s, round(avg(l_quantity), 9) AS m FROM {lineitem} GROUP BY l_returnflag",
    "agg_group_null_keys": "SELECT nullif(o_orderstatus, 'F') AS s, nullif(o_custkey % 5, 2) AS c, count(*) AS n FROM {orders} GROUP BY nullif(o_orderstatus, 'F'), nullif(o_custkey % 5, 2)",
    "sort_limit_offset": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 10",
    "sort_null_order": "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') ASC NULLS FIRST, o_orderkey) AS BIGINT) AS low, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey) AS BIGINT) AS high FROM {orders}",
    "top_k_per_group": "SELECT c_nationkey, c_custkey, CAST(r AS BIGINT) AS r FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM {customer}) t WHERE r <= 3",
    # -- windows
    "window_ranking": "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) AS BIGINT) AS rn, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS nt FROM {orders} WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)",
    "window_distribution": "SELECT c_custkey, round(percent_rank() OVER w, 12) AS pr, round(cume_dist() OVER w, 12) AS cd FROM {customer} WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)",
    "window_navigation": "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(o_orderkey, 2) OVER w AS second FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "window_rows_frame": "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS moving FROM {orders}",
    "window_range_frame": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM {lineitem}",
    # -- set operations, CTEs, set-returning functions
    "set_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "set_union_all": "SELECT n_name AS name FROM {nation} UNION ALL SELECT r_name FROM {region}",
    "set_intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "set_intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "set_except": "SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0",
    "set_except_all": "SELECT o_custkey AS k FROM {orders} EXCEPT ALL SELECT c_custkey FROM {customer}",
    "cte_chain": "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN {customer} ON o_custkey = c_custkey WHERE n > 2",
    "cte_recursive": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "srf_generate_series": ("SELECT n_nationkey, i FROM {nation} LATERAL VIEW explode(sequence(1, 3)) v AS i", "SELECT n_nationkey, CAST(i AS INTEGER) AS i FROM {nation}, generate_series(1, 3) g(i)"),
    "srf_unnest": ("SELECT vec_id, p + 1 AS pos, CAST(x AS DOUBLE) AS x FROM {embeddings} LATERAL VIEW posexplode(embedding) v AS p, x", "SELECT vec_id, CAST(p AS INTEGER) AS pos, CAST(embedding[p] AS DOUBLE) AS x FROM {embeddings}, generate_series(1, len(embedding)) g(p)"),
    # -- TPC-H shapes over the driver tables
    "tpch_q3_shape": "SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue, o_orderdate FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "tpch_q6_shape": "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "tpch_q13_shape": "SELECT n, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY n",
    "tpch_q17_shape": "SELECT count(*) AS n FROM {lineitem} l JOIN {part} ON p_partkey = l_partkey WHERE l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM {lineitem} i WHERE i.l_partkey = l.l_partkey)",
    "tpch_q18_shape": "SELECT o_orderkey, o_custkey, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 180) GROUP BY o_orderkey, o_custkey",
}


def _join_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pairs_within(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", ("a", "b"))


def _join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") + 9500).alias("low"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return R.less_join(customers, suppliers, "low", "s_acctbal").where("s_nationkey <> c_nationkey").select("s_suppkey", "c_custkey")


def _window_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return R.rankings(orders, "o_orderstatus", "o_orderpriority", "o_orderkey", 4).select("o_orderkey", "rk", "dr", "rn", "nt")


#: Queries whose text Spark would run in a task or three, or by comparing all with all: the same rows by operators.
OPERATORS: dict[str, Query] = {"join_self": _join_self, "join_theta": _join_theta, "window_ranking": _window_ranking}


def _register(name: str, spark_sql: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = sorted(set(re.findall(r"\{(\w+)\}", spark_sql)))
        return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in used})

    run.__name__ = name
    query(re.sub(r"\{(\w+)\}", r"\1", oracle), name)(OPERATORS.get(name, run))


for _name, _text in SQL.items():
    _register(_name, *(_text if isinstance(_text, tuple) else (_text, _text)))
