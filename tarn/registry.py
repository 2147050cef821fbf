"""Registered queries: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its own name."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        if key in _queries:
            raise ValueError(f"query {key} is registered twice")
        _queries[key] = f
        if oracle:
            _oracles[key] = oracle
        return f

    return register


def _load() -> None:
    import tarn.operators.catalogue  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
