"""Queries through the engine's own DataFrame operators and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn import functions as P
from tarn.operators import relational as R
from tarn.registry import query, table


@query("SELECT c_custkey FROM customer WHERE nullif(c_custkey, 5) NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def null_aware_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").withColumn("k", F.nullif("c_custkey", F.lit(5)))
    return R.null_aware_anti(left, table(spark, sf_dir, "orders").where("o_totalprice > 250000"), "k", "o_custkey").select("c_custkey")


@query("SELECT s_suppkey, nullif(s_suppkey, 3) IN (SELECT nullif(l_suppkey, 4) FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 7) AS mark FROM supplier")
def mark_join_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "supplier").select("s_suppkey", F.nullif("s_suppkey", F.lit(3)).alias("k"))
    right = table(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_linenumber = 7").select(F.nullif("l_suppkey", F.lit(4)).alias("r"))
    return R.mark_join(left, right, "k", "r").select("s_suppkey", "mark")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM customer")
def correlated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return R.scalar_subquery(customers, orders, {"c_custkey": "o_custkey"}, F.count("*"), "n", F.lit(0).cast("bigint"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = R.distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").asc()])
    return latest.select("o_custkey", "o_orderkey")


@query("SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS r FROM part) t WHERE r <= 10")
def limit_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.limit_with_ties(table(spark, sf_dir, "part"), 10, [F.col("p_size")]).select("p_partkey", "p_size")


@query(
    """SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority
       GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM orders"""
)
def groups_frame_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = R.groups_frame(table(spark, sf_dir, "orders"), ["o_orderstatus"], F.col("o_orderpriority"), 1, 0, {"near": F.count("*")})
    return framed.select("o_orderkey", "near")


@query("SELECT o_orderkey, l_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey BETWEEN l_orderkey AND l_orderkey + l_linenumber * 2 WHERE l_quantity > 45")
def interval_join_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select("o_orderkey")
    right = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") + F.col("l_linenumber") * 2).alias("high"))
    return R.interval_join(left, right, "o_orderkey", "l_orderkey", "high", 8).select("o_orderkey", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, s FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, rank() OVER (ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST, o_custkey % 7) AS r FROM orders) t WHERE r <= 25")
def limit_with_ties_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("F")))
    return R.limit_with_ties(orders, 25, [F.col("s").desc_nulls_last(), F.col("o_custkey") % 7]).select("o_orderkey", "s")


@query("SELECT o_orderkey, s FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, rank() OVER (ORDER BY nullif(o_orderstatus, 'F') ASC NULLS LAST, o_orderpriority DESC) AS r FROM orders) t WHERE r <= 10")
def limit_with_ties_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("F")))
    return R.limit_with_ties(orders, 10, [F.col("s"), F.col("o_orderpriority").desc()]).select("o_orderkey", "s")


@query("SELECT o_orderstatus, string_agg(o_orderkey::VARCHAR, ',' ORDER BY nullif(o_custkey % 4, 1) DESC NULLS FIRST, o_orderkey) AS keys FROM orders GROUP BY o_orderstatus, o_custkey % 50")
def string_agg_mixed_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = P.string_agg(F.col("o_orderkey").cast("string"), ",", [F.nullif(F.col("o_custkey") % 4, F.lit(1)), F.col("o_orderkey")], [True, False])
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.col("o_custkey") % 50).agg(listed.alias("keys")).select("o_orderstatus", "keys")


@query("SELECT o_orderkey FROM orders")
def table_sample_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return R.table_sample(orders, 100, 7).unionByName(R.table_sample(orders, 0, 7))


@query("SELECT n_name, rtrim(n_name) = rtrim(n_name || '   ') AS same, (n_nationkey > 3) IS NOT DISTINCT FROM TRUE AS t, (n_nationkey > 3) IS NOT DISTINCT FROM FALSE AS f, nullif(n_nationkey, 4) IS NULL AS u FROM nation")
def truth_tests_and_bpchar(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_name", P.bpchar_eq(F.col("n_name"), F.concat("n_name", F.lit("   "))).alias("same"), P.is_true(key > 3).alias("t"), P.is_false(key > 3).alias("f"), P.is_unknown(F.nullif(key, F.lit(4))).alias("u"))


@query("SELECT o_orderkey, round(o_totalprice * 1.1 + o_custkey, 6) AS charged FROM orders WHERE o_custkey % 3 <> 0")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    P.register_scalar(spark, "tarn_charged", lambda price, key: price * 1.1 + key, "double")
    orders = table(spark, sf_dir, "orders").withColumn("key", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")))
    charged = orders.select("o_orderkey", F.call_function("tarn_charged", "o_totalprice", "key").alias("c"))
    return charged.where(F.col("c").isNotNull()).select("o_orderkey", F.round("c", 6).alias("charged"))


@query("SELECT o_orderstatus, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_orderstatus")
def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    P.register_aggregate(spark, "tarn_spread", lambda values: values.max() - values.min(), "double")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.call_function("tarn_spread", "o_totalprice").alias("spread"))


@query("SELECT n_nationkey, upper(w) AS word FROM (SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS w FROM nation) t")
def udf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    P.register_table(spark, "tarn_words", lambda key, name: ((key, w.upper()) for w in name.split(" ")), "n_nationkey int, word string")
    return spark.sql("SELECT w.n_nationkey, w.word FROM {nation}, LATERAL tarn_words(CAST(n_nationkey AS INT), n_name) w", nation=table(spark, sf_dir, "nation"))


@query("SELECT n_regionkey, string_agg(coalesce(nullif(n_name, 'CHINA'), '-'), ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def array_agg_keeps_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    listed = nation.groupBy("n_regionkey").agg(P.array_agg(F.nullif("n_name", F.lit("CHINA")), [F.col("n_nationkey")]).alias("a"))
    return listed.select("n_regionkey", F.array_join("a", ",", "-").alias("names"))


@query("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def string_agg_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(P.string_agg(F.col("n_name"), "; ", [F.col("n_nationkey")]).alias("names"))


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS FLOAT)::DOUBLE) AS FLOAT) AS s FROM lineitem GROUP BY l_returnflag")
def sum_real_rounds_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(P.sum_real(F.col("l_quantity").cast("float")).alias("s"))


@query(
    """SELECT l_returnflag, CAST(CAST((sum(CAST(l_extendedprice AS DECIMAL(15,2)))::DECIMAL(24,2) * 1000000)::HUGEINT // count(*) AS DECIMAL(38,0)) AS DOUBLE) / 1000000.0 AS mean
       FROM lineitem GROUP BY l_returnflag"""
)
def avg_numeric_truncates(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = P.avg_numeric(F.col("l_extendedprice"), 15, 2, truncate=True)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(mean.alias("m")).select("l_returnflag", (F.col("m").cast("decimal(38,6)") * 1000000).cast("double").alias("m")).select("l_returnflag", (F.col("m") / 1000000.0).alias("mean"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 'NaN' ELSE 'Infinity' END
       ELSE 'finite' END AS kind FROM orders"""
)
def float_division_ieee(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = P.float_div(F.col("o_custkey") % 3, F.col("o_orderkey") % 4)
    kind = F.when(F.isnan(q), "NaN").when(F.abs(q) == float("inf"), "Infinity").otherwise("finite")
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))


@query("SELECT p_partkey, ceil(p_retailprice * 1e17) AS c, floor(-p_retailprice) AS f FROM part")
def ceil_floor_any_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", P.ceil_float(price * 1e17).alias("c"), P.floor_float(-price).alias("f"))


@query("SELECT n_name, substring(n_name, 1, 2) AS a, substring(n_name, 1, greatest(0, n_nationkey - 2)) AS b FROM nation")
def substring_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select("n_name", P.substring(name, F.lit(-1), F.lit(4)).alias("a"), P.substring(name, F.lit(-1), F.col("n_nationkey")).alias("b"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= 0 THEN o_orderkey // 9 ELSE -((-o_orderkey) // 9) END AS q, o_orderkey % 9 AS r FROM orders")
def integer_division_and_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", P.int_div("o_orderkey", 9).alias("q"), P.pg_mod("o_orderkey", 9).alias("r"))


@query("SELECT o_orderstatus, CAST(sum(o_orderkey::HUGEINT * 4611686018427) AS VARCHAR) AS total FROM orders GROUP BY o_orderstatus")
def sum_bigint_as_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(P.sum_bigint(F.col("o_orderkey").cast("decimal(20,0)") * F.lit(4611686018427)).cast("string").alias("total"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'")
def bound_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT o_orderkey FROM {o} WHERE o_totalprice > :low AND o_orderstatus = :status", args={"low": 150000, "status": "O"}, o=table(spark, sf_dir, "orders"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def events_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
