import decimal
import math

import pytest
from pyspark.sql import functions as F

from tarn import functions as P
from tarn.operators import relational as R


def one(df):
    return df.first()[0]


def test_sum_bigint_does_not_overflow(spark):
    df = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,), (None,)], "x bigint")
    assert one(df.agg(P.sum_bigint(F.col("x")))) == 2 * (2**63 - 1)


def test_sum_real_rounds_once_and_overflows(spark):
    df = spark.createDataFrame([(16777216.0,), (1.0,), (1.0,)], "x float")
    assert one(df.agg(P.sum_real(F.col("x")))) == 16777218.0
    with pytest.raises(Exception, match="overflow"):
        spark.createDataFrame([(3e38,), (3e38,)], "x float").agg(P.sum_real(F.col("x"))).collect()
    assert one(spark.createDataFrame([(float("inf"),), (1.0,)], "x float").agg(P.sum_real(F.col("x")))) == math.inf
    assert one(spark.createDataFrame([], "x float").agg(P.sum_real(F.col("x")))) is None


def test_avg_numeric_rounds_or_truncates(spark):
    df = spark.createDataFrame([(decimal.Decimal(v),) for v in ("1.00", "2.00", "2.00")], "x decimal(15,2)")
    assert one(df.agg(P.avg_numeric(F.col("x"), 15, 2))) == decimal.Decimal("1.666667")
    assert one(df.agg(P.avg_numeric(F.col("x"), 15, 2, truncate=True))) == decimal.Decimal("1.666666")


def test_float_division_is_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(P.float_div("a", "b")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 1.5 and got[4] is None


def test_integer_arithmetic(spark):
    df = spark.createDataFrame([(-7, 2), (7, -2), (-(2**63), -1)], "a bigint, b bigint")
    assert [r[0] for r in df.select(P.pg_mod("a", "b")).collect()] == [-1, 1, 0]
    assert [r[0] for r in df.where("b <> -1").select(P.int_div("a", "b")).collect()] == [-3, -3]


def test_ceil_and_floor_of_any_magnitude(spark):
    df = spark.createDataFrame([(1e20,), (-1.5,), (math.inf,)], "x double")
    assert [tuple(r) for r in df.select(P.ceil_float("x"), P.floor_float("x")).collect()] == [(1e20, 1e20), (-1.0, -2.0), (math.inf, math.inf)]


@pytest.mark.parametrize(("start", "length", "want"), [(0, 3, "he"), (-2, 4, "h"), (2, 2, "el"), (1, 0, ""), (-5, 2, ""), (4, 100, "lo")])
def test_substring_positions_before_the_text(spark, start, length, want):
    assert one(spark.range(1).select(P.substring(F.lit("hello"), F.lit(start), F.lit(length)))) == want


def test_substring_negative_length_is_an_error(spark):
    with pytest.raises(Exception, match="negative substring"):
        spark.range(1).select(P.substring(F.lit("hello"), F.lit(1), F.lit(-1))).collect()


def test_array_agg_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([(2, None), (1, "b"), (None, "z"), (3, "a")], "k int, x string")
    assert one(df.agg(P.array_agg(F.col("x"), [F.col("k")]))) == ["b", None, "a", "z"]
    assert one(df.where("false").agg(P.array_agg(F.col("x")))) is None
    assert one(df.agg(P.string_agg(F.col("x"), None, [F.col("k")]))) == "baz"


def test_boolean_tests_and_not_in(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    got = [tuple(r) for r in df.select(P.is_true("b"), P.is_false("b"), P.is_unknown("b"), P.strict_true("b")).collect()]
    assert got == [(True, False, False, True), (False, True, False, True), (False, False, True, None)]
    assert spark.range(3).where(P.not_in_list("id", [1, None])).count() == 0
    assert one(spark.range(1).select(P.bpchar_eq(F.lit("ab  "), F.lit("ab"))))


def test_decimal_products_are_exact_or_refused(spark):
    df = spark.createDataFrame([(decimal.Decimal("1.25"), decimal.Decimal("3.5"))], "a decimal(10,2), b decimal(8,1)")
    assert one(df.select(P.decimal_product(F.col("a"), F.col("b"), (10, 2), (8, 1)))) == decimal.Decimal("4.375")
    with pytest.raises(ValueError, match="38"):
        P.decimal_product(F.col("a"), F.col("b"), (30, 2), (20, 2))


def test_sql_names(spark):
    P.register_sql_functions(spark)
    assert tuple(spark.sql("SELECT starts_with('abc', 'ab'), pg_substr('hello', 0, 3), int_div(-7, 2)").first()) == (True, "he", -3)


@pytest.mark.parametrize(("left", "right", "want"), [([1, 2, None], [2], [1]), ([1, None], [], [1, None]), ([1, 2], [2, None], []), ([], [1], [])])
def test_null_aware_anti(spark, left, right, want):
    a, b = spark.createDataFrame([(v,) for v in left], "k int"), spark.createDataFrame([(v,) for v in right], "r int")
    assert sorted((r[0] for r in R.null_aware_anti(a, b, "k", "r").collect()), key=str) == sorted(want, key=str)


def test_mark_join_is_three_valued(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (1,), (None,)], "r int")
    assert {r["k"]: r["mark"] for r in R.mark_join(a, b, "k", "r").collect()} == {1: True, 2: None, None: None}
    assert {r["k"]: r["mark"] for r in R.mark_join(a, b.where("false"), "k", "r").collect()} == {1: False, 2: False, None: False}


def test_interval_join_and_ties(spark):
    points = spark.createDataFrame([(k,) for k in (0, 5, 9, 10, 25)], "p int")
    spans = spark.createDataFrame([(0, 9, "a"), (9, 30, "b"), (40, 50, "c")], "lo int, hi int, n string")
    got = sorted((r["p"], r["n"]) for r in R.interval_join(points, spans, "p", "lo", "hi", 10).collect())
    assert got == [(0, "a"), (5, "a"), (9, "a"), (9, "b"), (10, "b"), (25, "b")]
    rows = spark.createDataFrame([(1,), (2,), (2,), (3,)], "v int")
    assert sorted(r[0] for r in R.limit_with_ties(rows, 2, [F.col("v")]).collect()) == [1, 2, 2]
