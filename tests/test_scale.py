"""Work of one key or one comparison of all with all goes to many tasks, with the same rows."""

import pytest
from pyspark.sql import functions as F

from tarn.operators import relational as R
from tarn.tables import IcebergTable, LakeTable, lake


def test_pairs_of_one_large_group_are_the_work_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 50)
    monkeypatch.setattr(R, "PAIRS", 5000)
    values = [(1, "x", k) for k in range(300)] + [(1, "x", 7), (1, "x", 7), (None, "x", 1), (1, None, 2), (1, "x", None), (2, "x", 1), (2, "x", 0), (3, "x", 5)]
    df = spark.createDataFrame(values, "k int, s string, v int").repartition(2)
    pairs = R.pairs_within(df, ["k", "s"], "v", ("a", "b"))
    got = sorted((r.a, r.b) for r in pairs.collect())
    whole = [v for v in values if None not in v]
    assert got == sorted((x[2], y[2]) for x in whole for y in whole if x[:2] == y[:2] and x[2] < y[2])
    tasks = [r[0] for r in pairs.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(tasks) > 4 and max(tasks) < len(got) / 3
    assert R.pairs_within(df.where("k > 9"), ["k"], "v", ("a", "b")).count() == 0


def test_less_join_compares_blocks_that_can_match(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 20)
    monkeypatch.setattr(R, "PAIRS", 2000)
    nan = float("nan")
    lows = [(k, float(k * 7 % 101)) for k in range(200)] + [(k, 50.0) for k in range(200, 300)] + [(300, None), (301, nan), (302, -0.0)]
    highs = [(k, float(k * 11 % 103)) for k in range(150)] + [(k, 50.0) for k in range(150, 250)] + [(250, None), (251, nan), (252, 0.0)]
    left, right = spark.createDataFrame(lows, "i int, low double"), spark.createDataFrame(highs, "j int, high double")
    joined = R.less_join(left, right, "low", "high")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    same = left.crossJoin(right).where("low < high")
    assert sorted((r.i, r.j) for r in joined.collect()) == sorted((r.i, r.j) for r in same.collect())
    for none in (left.where("i < 0"), left.where("low IS NULL"), left.where("low > 1000 AND NOT isnan(low)")):
        assert R.less_join(none, right, "low", "high").count() == 0
    assert R.less_join(left, right.limit(0), "low", "high").count() == 0


def test_join_theta_plans_no_nested_loop(spark):
    from tarn import registry

    plan = registry.queries()["join_theta"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("few", [0, 1000])
def test_deleted_places_are_broadcast_only_where_few(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(lake, "FEW", few, raising=False)
    monkeypatch.setattr(lake, "JOINED", 100, raising=False)
    rows = spark.range(900).selectExpr("id AS file", "id % 3 AS pos", "CAST(id AS STRING) AS path", "id % 2 AS _number")
    made = LakeTable.create_as(rows.repartition(3), f"{tmp_path}/t", partition_by=["pos"])
    assert made.delete(F.col("file") % 5 == 0) == 180
    assert made.update([("pos", "=", 1)], {"path": F.lit("new")}) == 240
    assert made.delete(F.col("file") % 7 == 0) == sum(k % 5 > 0 and k % 7 == 0 for k in range(900))
    scan = made.scan()
    kept = [k for k in range(900) if k % 5 and k % 7]
    assert sorted((r["file"], r["pos"], r["path"], r["_number"]) for r in scan.collect()) == [(k, k % 3, "new" if k % 3 == 1 else str(k), k % 2) for k in kept]
    anti = [x for x in scan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftAnti" in x]
    assert anti and all(("broadcast" in x) == bool(few) and ("merge" in x) == (not few) for x in anti)


def test_statistics_of_files_sort_no_rows(spark, tmp_path, monkeypatch):
    plans = []

    def collect(self, whole=type(spark.range(1)).collect):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return whole(self)

    monkeypatch.setattr(type(spark.range(1)), "collect", collect)
    rows = spark.range(100).selectExpr("id", "CAST(id AS STRING) AS name")
    made = LakeTable.create_as(rows, f"{tmp_path}/t")
    assert sorted(v for f in made.plan_files() for v in f["stats"]["2"][:2])[::-1][0] == "99"
    IcebergTable.create(spark, f"{tmp_path}/i", rows.schema).append(rows)
    described = [p for p in plans if "min(" in p]
    assert len(described) == 2 and all("ObjectHashAggregate" in p and "SortAggregate" not in p for p in described)


def test_rankings_of_a_large_group_are_the_work_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", 40)
    rows = [("F" if k % 10 else "O", f"{k * 7 % 5}", k * 3) for k in range(600)] + [(None, "1", 5), (None, None, 1), (None, "1", 2), ("P", "2", 7), ("O", "1", None)]
    df = spark.createDataFrame(rows, "s string, p string, k bigint").repartition(3)
    ranked = R.rankings(df, "s", "p", "k", 4)
    w = "PARTITION BY s ORDER BY p NULLS LAST"
    df.createOrReplaceTempView("ranked_rows")
    same = spark.sql(f"SELECT s, p, k, rank() OVER ({w}), dense_rank() OVER ({w}), row_number() OVER ({w}, k NULLS LAST), ntile(4) OVER (PARTITION BY s ORDER BY k NULLS LAST) FROM ranked_rows")
    assert sorted(map(str, map(tuple, ranked.collect()))) == sorted(map(str, map(tuple, same.collect())))
    tasks = [r[0] for r in ranked.where("s = 'F'").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(tasks) > 2 and max(tasks) < 400
    assert R.rankings(df.limit(0), "s", "p", "k", 4).count() == 0
