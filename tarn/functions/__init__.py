"""Column expressions with PostgreSQL value semantics where Spark's own differ."""

from tarn.functions.aggregates import array_agg, avg_numeric, float_stat, string_agg, sum_bigint, sum_numeric, sum_real
from tarn.functions.scalars import (
    bpchar_eq,
    ceil_float,
    decimal_product,
    float_div,
    floor_float,
    int_div,
    is_false,
    is_true,
    is_unknown,
    not_in_list,
    pg_mod,
    register_sql_functions,
    strict_false,
    strict_true,
    substring,
)

from tarn.functions.udfs import register_aggregate, register_scalar, register_table

__all__ = [
    "register_aggregate",
    "register_scalar",
    "register_table",
    "array_agg",
    "avg_numeric",
    "bpchar_eq",
    "ceil_float",
    "decimal_product",
    "float_div",
    "float_stat",
    "floor_float",
    "int_div",
    "is_false",
    "is_true",
    "is_unknown",
    "not_in_list",
    "pg_mod",
    "register_sql_functions",
    "strict_false",
    "strict_true",
    "string_agg",
    "substring",
    "sum_bigint",
    "sum_numeric",
    "sum_real",
]
