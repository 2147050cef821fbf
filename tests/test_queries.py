"""Every registered query runs at sf0.001 and equals its oracle."""

import glob
import math
import os

import numpy as np
import pandas as pd
import pytest

from tarn import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")


def normal(frame):
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, bool | np.bool_):
            return str(bool(v))
        return f"{float(v):.9g}" if isinstance(v, int | float | np.number) or type(v).__name__ == "Decimal" else str(v)

    return list(frame.columns), sorted(tuple(map(cell, row)) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in glob.glob(f"{DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_oracle(spark, oracle, name):
    got = registry.queries()[name](spark, DIR).toPandas()
    if name in registry.oracle_sql():
        assert normal(got) == normal(oracle.execute(registry.oracle_sql()[name]).df())


def test_plans_prune_and_push_down(spark):
    """Only the columns and row groups that a query needs are read, and no Python runs in relational plans."""
    plan = registry.queries()["tpch_q6_shape"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "l_comment" not in plan and "Python" not in plan
    anti = registry.queries()["null_aware_anti_join"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in anti


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
