"""Registration of Python functions under SQL names, by Arrow batches.

Built-in expressions stay in the JVM and are always preferable; these are for what no expression says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_scalar(spark: SparkSession, name: str, function: Callable, returns: str, strict: bool = True, volatile: bool = False) -> None:
    """A scalar function over columns as Series. ``strict``: NULL if any argument is NULL, without calling ``function``."""

    def run(*columns: pd.Series) -> pd.Series:
        if not strict:
            return pd.Series(function(*columns))
        known = pd.concat([c.notna() for c in columns], axis=1).all(axis=1)
        out = pd.Series([None] * len(known), index=known.index, dtype=object)
        if known.any():
            out[known] = pd.Series(function(*[c[known] for c in columns]), index=out[known].index).astype(object)
        return out

    made = F.pandas_udf(_series(run, function), returns)
    spark.udf.register(name, made.asNondeterministic() if volatile else made)


def _series(run: Callable, function: Callable) -> Callable:
    """``run`` with as many annotated parameters as ``function`` has, as Spark reads the kind of a function from them."""
    n = function.__code__.co_argcount
    if n == 1:

        def one(a: pd.Series) -> pd.Series:
            return run(a)

        return one
    if n == 2:

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)

        return two

    def many(*columns: pd.Series) -> pd.Series:
        return run(*columns)

    return many


def register_aggregate(spark: SparkSession, name: str, function: Callable[[pd.Series], object], returns: str) -> None:
    """An aggregate of one column; ``function`` sees a group's non-NULL values, and an empty group gives NULL."""

    def run(values: pd.Series) -> object:
        known = values.dropna()
        return function(known) if len(known) else None

    run.__annotations__ = {"values": pd.Series, "return": object}

    def typed(values: pd.Series) -> float:
        return run(values)

    spark.udf.register(name, F.pandas_udf(typed, returns))


def register_table(spark: SparkSession, name: str, function: Callable[..., Iterable[tuple]], returns: str) -> None:
    """A set-returning function: ``function`` gives the rows for one row of arguments."""

    class Rows:
        def eval(self, *arguments):
            yield from function(*arguments)

    spark.udtf.register(name, F.udtf(Rows, returnType=returns))
