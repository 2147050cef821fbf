"""Aggregate expressions with exact result types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_bigint(x: Column) -> Column:
    """sum of bigint as numeric(38,0): never overflows a long."""
    return F.sum(x.cast("decimal(38,0)"))


def sum_numeric(x: Column, precision: int, scale: int) -> Column:
    """sum of numeric(p,s) as numeric(p+20,s), capped at 38 digits."""
    return F.sum(x.cast(f"decimal({precision},{scale})")).cast(f"decimal({min(38, precision + 20)},{scale})")


def sum_real(x: Column) -> Column:
    """sum of real: accumulated in double, rounded once, finite inputs that overflow are an error."""
    total = F.sum(x.cast("double"))
    finite = F.coalesce(F.bool_and(~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(True))
    too_large = F.abs(total) > 3.4028235677973366e38
    return F.when(finite & too_large, F.raise_error(F.lit("value out of range: overflow")).cast("float")).otherwise(total.cast("float"))


def avg_numeric(x: Column, precision: int, scale: int, truncate: bool = False) -> Column:
    """avg of numeric(p,s) with scale s+4: rounded (nearer to PostgreSQL), or truncated (the engine's own rule)."""
    out = min(38, max(precision, 26) + 4), scale + 4
    value = x.cast(f"decimal({precision},{scale})")
    total, n = F.sum(value), F.count(value)
    if not truncate:
        return F.avg(value).cast(f"decimal({out[0]},{out[1]})")
    scaled = (total.cast(f"decimal({min(38, precision + 10)},{scale})") * F.lit(10 ** (scale + 4)).cast("decimal(18,0)")).cast("decimal(38,0)")
    whole = F.call_function("div", scaled, F.when(n > 0, n).cast("decimal(20,0)"))
    return (whole.cast("decimal(38,0)") / F.lit(10 ** (scale + 4)).cast("decimal(18,0)")).cast(f"decimal({out[0]},{out[1]})")


def float_stat(name: str, x: Column) -> Column:
    """variance, var_pop, stddev and the like in double, with PostgreSQL's names."""
    known = {"variance": F.var_samp, "var_samp": F.var_samp, "var_pop": F.var_pop, "stddev": F.stddev_samp, "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop}
    return known[name](x.cast("double"))


def _before(descending: list[bool]) -> Callable[[Column, Column], Column]:
    """A comparator of entries with fields n0, k0, n1, k1, ...: ascending NULLS LAST, descending NULLS FIRST."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for k in reversed(range(len(descending))):
            step = -1 if descending[k] else 1
            out = (
                F.when(a[f"n{k}"] != b[f"n{k}"], F.when(a[f"n{k}"], F.lit(step)).otherwise(F.lit(-step)))
                .when(a[f"k{k}"] < b[f"k{k}"], F.lit(-step))
                .when(a[f"k{k}"] > b[f"k{k}"], F.lit(step))
                .otherwise(out)
            )
        return out

    return compare


def array_agg(x: Column, order_by: list[Column] | None = None, descending: bool | list[bool] = False, distinct: bool = False) -> Column:
    """All values, NULLs too, in the order of the keys; NULL for no rows. Keys sort NULLS LAST (descending: FIRST).

    ``descending``: for all keys, or one flag for each.
    """
    if order_by is None:
        kept = F.collect_list(F.struct(x.alias("x")))
        listed = F.transform(F.array_distinct(kept) if distinct else kept, lambda e: e.x)
    else:
        down = [descending] * len(order_by) if isinstance(descending, bool) else list(descending)
        if len(down) != len(order_by):
            raise ValueError("one direction for each key, or one for all")
        keys = [part for k, key in enumerate(order_by) for part in (key.isNull().alias(f"n{k}"), key.alias(f"k{k}"))]
        entries = F.collect_list(F.struct(*keys, x.alias("x")))
        if len(set(down)) > 1:
            ordered = F.array_sort(entries, _before(down))
        else:
            ordered = F.reverse(F.array_sort(entries)) if down[0] else F.array_sort(entries)
        listed = F.transform(ordered, lambda e: e.x)
    return F.when(F.size(listed) > 0, listed)


def string_agg(x: Column, delimiter: str | None, order_by: list[Column] | None = None, descending: bool | list[bool] = False) -> Column:
    """Non-NULL strings joined by a constant delimiter (NULL: empty), in the order of the keys; NULL for none."""
    listed = F.filter(array_agg(x, order_by, descending), lambda e: e.isNotNull())
    return F.when(F.size(listed) > 0, F.array_join(listed, delimiter or ""))
