"""Scalar expressions: all JVM-side, none of them a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Value = Column | int | float | str


def _col(value: Value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def int_div(a: Value, b: Value, kind: str = "bigint") -> Column:
    """Integer division that truncates towards zero, in type ``kind``; a zero divisor and an overflow are errors."""
    return F.call_function("div", _col(a), _col(b)).cast(kind)


def pg_mod(a: Value, b: Value) -> Column:
    """The remainder with the dividend's sign; the least value modulo -1 is 0."""
    return F.when(_col(b) == -1, F.lit(0)).otherwise(_col(a) % _col(b))


def float_div(a: Value, b: Value) -> Column:
    """IEEE division of floats: x/0 is an infinity with the sign of x and 0/0 is NaN, instead of Spark's error."""
    x, y = _col(a).cast("double"), _col(b).cast("double")
    by_zero = F.when(x.isNull(), F.lit(None)).when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, by_zero).otherwise(x / F.when(y != 0, y))


def ceil_float(x: Value) -> Column:
    """ceil of a double as a double of any magnitude; Spark's own returns a bigint and saturates."""
    return F.when(F.abs(_col(x)) < float(1 << 53), F.ceil(F.when(F.abs(_col(x)) < float(1 << 53), _col(x))).cast("double")).otherwise(_col(x))


def floor_float(x: Value) -> Column:
    return F.when(F.abs(_col(x)) < float(1 << 53), F.floor(F.when(F.abs(_col(x)) < float(1 << 53), _col(x))).cast("double")).otherwise(_col(x))


def substring(text: Value, start: Value, length: Value | None = None) -> Column:
    """Positions before 1 lie before the text, as in PostgreSQL; a negative length is an error."""
    begin = _col(start).cast("bigint")
    if length is None:
        return F.substring(_col(text), F.greatest(begin, F.lit(1)).cast("int"), F.lit((1 << 31) - 1))
    size = _col(length).cast("bigint")
    checked = F.when(size < 0, F.raise_error(F.lit("negative substring length not allowed")).cast("bigint")).otherwise(size)
    end = begin + checked
    shown = F.greatest(F.lit(0), F.least(end, F.lit(1 << 31)) - F.greatest(begin, F.lit(1)))
    return F.substring(_col(text), F.least(F.greatest(begin, F.lit(1)), F.lit((1 << 31) - 1)).cast("int"), F.least(shown, F.lit((1 << 31) - 1)).cast("int"))


def bpchar_eq(a: Value, b: Value) -> Column:
    """char(n) equality: trailing blanks do not count."""
    return F.rtrim(_col(a)) == F.rtrim(_col(b))


def is_true(x: Value) -> Column:
    return _col(x).eqNullSafe(F.lit(True))


def is_false(x: Value) -> Column:
    return _col(x).eqNullSafe(F.lit(False))


def is_unknown(x: Value) -> Column:
    return _col(x).isNull()


def strict_true(x: Value) -> Column:
    """TRUE unless the argument is NULL."""
    return F.when(_col(x).isNotNull(), F.lit(True))


def strict_false(x: Value) -> Column:
    return F.when(_col(x).isNotNull(), F.lit(False))


def not_in_list(x: Value, values: list) -> Column:
    """x NOT IN (…) with three-valued logic: a NULL in the list never yields TRUE."""
    return ~_col(x).isin(*values) if values else F.lit(True)


def decimal_product(a: Column, b: Column, precision_a: tuple[int, int], precision_b: tuple[int, int]) -> Column:
    """The exact product of decimals with declared (precision, scale); more than 38 digits is an error, never a cut scale."""
    digits, scale = precision_a[0] + precision_b[0], precision_a[1] + precision_b[1]
    if digits > 38:
        raise ValueError(f"an exact product needs numeric({digits},{scale}); at most 38 digits are supported")
    return (a.cast(f"decimal({precision_a[0]},{precision_a[1]})") * b.cast(f"decimal({precision_b[0]},{precision_b[1]})")).cast(f"decimal({digits},{scale})")


def register_sql_functions(spark: SparkSession) -> None:
    """SQL names that Spark lacks, as temporary SQL functions (inlined by Catalyst)."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION starts_with(a STRING, b STRING) RETURNS BOOLEAN RETURN startswith(a, b)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pg_substr(t STRING, s INT, n INT) RETURNS STRING RETURN substring(t, greatest(s, 1), greatest(0, s + n - greatest(s, 1)))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION int_div(a BIGINT, b BIGINT) RETURNS BIGINT RETURN a div b")
