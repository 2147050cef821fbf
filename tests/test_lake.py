import datetime as dt
import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.tables import CommitConflict, LakeTable
from tarn.tables.files import Store
from tarn.tables.transforms import Transform

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("day", T.DateType())])


def rows(spark, *values):
    return spark.createDataFrame([(i, s, dt.date(2024, 1, d)) for i, s, d in values], SCHEMA)


def content(table):
    table.refresh()
    return sorted((r["id"], r["label"]) for r in table.scan(["id", "label"]).collect())


@pytest.fixture
def table(spark, tmp_path):
    t = LakeTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["day(day)"])
    t.insert(rows(spark, (1, "a", 1), (2, "b", 2), (3, "c", 3)))
    return t


def test_insert_prune_count(spark, table):
    assert table.count() == 3 and table.scan().count() == 3
    where = [("day", "=", dt.date(2024, 1, 2))]
    assert len(table.plan_files(where)) == 1 and "files 1 of 3" in table.explain(where)
    assert [r["id"] for r in table.scan(["id"], where).collect()] == [2]
    assert len(table.plan_files([("id", ">", 2)])) == 1
    assert table.plan_files([("label", "is null", None)]) == []
    assert len(table.plan_files([("id", "in", [1, 3, 99])])) == 2


def test_delete_update(spark, table):
    assert table.delete(F.col("id") == 1) == 1
    assert table.count() == 2 and content(table) == [(2, "b"), (3, "c")]
    assert table.update([("id", "=", 2)], {"label": F.lit("B")}) == 1
    assert content(table) == [(2, "B"), (3, "c")]
    assert table.delete([("id", "=", 77)]) == 0
    assert sorted(r["id"] for r in table.scan(snapshot_id=1).collect()) == [1, 2, 3]


def test_merge(spark, table):
    source = rows(spark, (2, "new", 2), (9, "nine", 9))
    done = table.merge(source, ["id"], update={"label": "s.label"})
    assert done == {"deleted": 1, "written": 2}
    assert content(table) == [(1, "a"), (2, "new"), (3, "c"), (9, "nine")]
    table.merge(rows(spark, (3, "x", 3)), ["id"], update={"label": "s.label"}, delete_when="s.label = 'x'", insert=False)
    assert content(table) == [(1, "a"), (2, "new"), (9, "nine")]
    with pytest.raises(ValueError, match="second time"):
        table.merge(source.union(source), ["id"], update={"label": "s.label"})


def test_schema_evolution(spark, table):
    table.add_column("extra", T.DoubleType())
    table.rename_column("label", "name")
    table.insert(spark.createDataFrame([(4, "d", dt.date(2024, 1, 4), 1.5)], "id int, name string, day date, extra double"))
    got = {r["id"]: (r["name"], r["extra"]) for r in table.scan().collect()}
    assert got == {1: ("a", None), 2: ("b", None), 3: ("c", None), 4: ("d", 1.5)}
    assert len(table.plan_files([("extra", "is null", None)])) == 3
    table.drop_column("name")
    table.add_column("name", T.StringType())
    assert all(r["name"] is None for r in table.scan(["name"]).collect())
    with pytest.raises(ValueError, match="partition spec"):
        table.drop_column("day")


def test_transaction_reads_its_own_writes(spark, table):
    other = LakeTable(spark, table.path)
    with table.transaction() as tx:
        tx.insert(rows(spark, (5, "e", 5)))
        mark = tx.savepoint()
        tx.insert(rows(spark, (6, "f", 6)))
        tx.rollback_to(mark)
        tx.delete(F.col("id").isin(1, 5))
        assert sorted(r["id"] for r in tx.scan().collect()) == [2, 3]
        assert other.count() == 3
    assert [i for i, _ in content(table)] == [2, 3]


def test_conflicts(spark, table):
    first, second = LakeTable(spark, table.path), LakeTable(spark, table.path)
    first.delete(F.col("id") == 1)
    with pytest.raises(CommitConflict):
        second._commit(None, "delete", [], [{"path": "x", "targets": [second.plan_files([("id", "=", 1)])[0]["path"]], "rows": 1}], [], [])
    third, fourth = LakeTable(spark, table.path), LakeTable(spark, table.path)
    third.insert(rows(spark, (20, "t", 20)))
    fourth.insert(rows(spark, (21, "u", 21)))
    assert [i for i, _ in content(table)] == [2, 3, 20, 21]
    fifth = LakeTable(spark, table.path)
    base = fifth.state
    LakeTable(spark, table.path).insert(rows(spark, (30, "v", 30)))
    fifth.state = base
    with pytest.raises(CommitConflict, match="may match"):
        fifth.delete([("id", ">", 20)])


def test_compaction_and_expiry(spark, tmp_path):
    t = LakeTable.create(spark, f"file://{tmp_path}/c", SCHEMA)
    for k in range(6):
        t.insert(rows(spark, (k, "x", 1)).coalesce(1))
    t.delete(F.col("id") == 0)
    report = t.compact()
    assert report["selected"] == 6 and report["rows"] == 5 and t.count() == 5 and not t.state.current["deletes"]
    assert t.expire_snapshots(older_than_ms=0) == 8 and t.scan().count() == 5
    with pytest.raises(ValueError, match="one day"):
        t.remove_orphans(0)
    assert t.remove_orphans() == 0
    assert t.snapshots().count() == 1 and t.files().count() == 1


def test_options_names_and_format_versions(spark, tmp_path):
    with pytest.raises(ValueError, match="options"):
        LakeTable.create(spark, f"file://{tmp_path}/o", SCHEMA, properties={"colour": "red"})
    with pytest.raises(ValueError, match="source"):
        LakeTable.create(spark, f"file://{tmp_path}/p", SCHEMA, ["day(nope)"])
    old = LakeTable.create_as(rows(spark, (1, "a", 1)), f"file://{tmp_path}/v1", properties={"format-version": "1"})
    with pytest.raises(ValueError, match="version 1"):
        old.delete(F.col("id") == 1)
    strict = LakeTable.create(spark, f"file://{tmp_path}/s", T.StructType([T.StructField("id", T.IntegerType(), False)]))
    with pytest.raises(ValueError, match="NULL"):
        strict.insert(spark.createDataFrame([(None,)], "id int"))
    strict.truncate()
    assert strict.count() == 0
    strict.drop()
    with pytest.raises(ValueError, match="no table"):
        LakeTable(spark, strict.path)


def test_partition_evolution(spark, table):
    table.replace_partition_spec(["bucket(4, id)", "truncate(1, label)"])
    table.insert(rows(spark, (7, "zz", 1)))
    assert [r["transform"] for r in table.partition_spec().collect()] == ["bucket(4, id)", "truncate(1, label)"]
    assert [r["id"] for r in table.scan(where=[("label", "=", "zz")]).collect()] == [7]
    assert content(table)[-1] == (7, "zz")


@pytest.mark.parametrize("text", ["a", "year(a)", "month(a)", "day(a)", "hour(a)", "bucket(3, a)", "truncate(2, a)"])
def test_transform_text_round_trip(text):
    assert str(Transform.parse(text)) == text


def test_returning(spark, table):
    assert [r["id"] for r in table.insert_returning(rows(spark, (8, "h", 1))).collect()] == [8]
    assert sorted(r["label"] for r in table.delete_returning(F.col("id") > 2).collect()) == ["c", "h"]
    assert table.delete_returning([("id", "=", 55)]).count() == 0 and [i for i, _ in content(table)] == [1, 2]


def test_catalog(spark, tmp_path):
    from tarn.tables import LakeCatalog, analyze

    catalog = LakeCatalog(spark, f"file://{tmp_path}/c")
    assert catalog.names() == []
    catalog.create("ns", "one", SCHEMA).insert(rows(spark, (1, "a", 1), (2, None, 2)))
    catalog.create("ns", "two", SCHEMA)
    assert catalog.names("ns") == [("ns", "one"), ("ns", "two")]
    assert {r["name"]: r["record_count"] for r in catalog.tables().collect()} == {"one": 2, "two": 0}
    assert set(catalog.import_schema("ns", but=["two"])) == {"one"} and spark.sql("SELECT count(*) FROM one").first()[0] == 2
    with pytest.raises(ValueError, match="no tables"):
        catalog.import_schema("ns", only=["three"])
    stats = {r["column"]: r for r in analyze(catalog.load("ns", "one"), fraction=1.0).collect()}
    assert stats["label"]["null_share"] == 0.5 and stats["id"]["high"] == "2"
    catalog.drop("ns", "two")
    assert catalog.names() == [("ns", "one")]


def test_server_scopes():
    from tarn.sources.access import Server, resolve

    servers = [Server("a", "s3a://x"), Server("b", "s3a://x/deep"), Server("c"), Server("d", "s3a://x/deep/")]
    assert resolve(servers[:3], "s3a://x/deep/f.csv").name == "b" and resolve(servers, "s3a://x/other").name == "a"
    assert resolve(servers, "s3a://xy/f") is None and resolve(servers, "s3a://q", "c").name == "c"
    with pytest.raises(ValueError, match="both serve"):
        resolve(servers, "s3a://x/deep/f.csv")
    with pytest.raises(ValueError, match="outside"):
        resolve(servers, "s3a://y/f", "a")


def test_orphans_of_a_stale_handle_keep_live_files(spark, table, tmp_path):
    stale = LakeTable(spark, table.path)
    LakeTable(spark, table.path).insert(rows(spark, (7, "g", 7)))
    LakeTable(spark, table.path).delete(F.col("id") == 1)
    lost = tmp_path / "t/data/lost.parquet"
    lost.write_bytes(b"x")
    old = time.time() - 5 * 86_400
    for path in (tmp_path / "t/data").rglob("*"):
        if path.is_file():
            os.utime(path, (old, old))
    stale.remove_orphans()
    assert not lost.exists() and [i for i, _ in content(table)] == [2, 3, 7]


def test_transactions_are_serializable(spark, table):
    with pytest.raises(CommitConflict, match="may match"):
        with table.transaction() as tx:
            tx.delete(F.col("id") >= 0)
            LakeTable(spark, table.path).insert(rows(spark, (8, "h", 8)))
    table.refresh()
    with table.transaction() as tx:  # another partition's rows are no conflict
        tx.delete([("id", "<=", 3)])
        LakeTable(spark, table.path).insert(rows(spark, (9, "i", 9)))
    assert [i for i, _ in content(table)] == [8, 9]
    with pytest.raises(CommitConflict, match="may match"):
        with table.transaction() as tx:
            tx.insert(tx.scan().withColumn("id", F.col("id") + 100))
            LakeTable(spark, table.path).insert(rows(spark, (10, "j", 10)))


def test_transaction_updates_and_merges(spark, table):
    with table.transaction() as tx:
        tx.update([("id", "=", 1)], {"label": F.lit("A")})
        tx.update(F.col("id") == 1, {"label": F.lit("AA")})
        tx.merge(rows(spark, (2, "two", 2), (5, "five", 5)), ["id"], update={"label": "s.label"})
        tx.delete([("id", "=", 3)])
        assert sorted((r["id"], r["label"]) for r in tx.scan().collect()) == [(1, "AA"), (2, "two"), (5, "five")]
    assert content(table) == [(1, "AA"), (2, "two"), (5, "five")]


def test_concurrent_writers_lose_nothing(spark, table):
    handles = [LakeTable(spark, table.path) for _ in range(8)]
    files = [h._write(rows(spark, (100 + k, "w", 1 + k))) for k, h in enumerate(handles)]
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda k: handles[k]._commit(None, "append", files[k], [], []), range(8)))
    assert [i for i, _ in content(table)] == [1, 2, 3, *range(100, 108)]


def test_a_name_is_created_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    with ThreadPoolExecutor(16) as pool:
        won = list(pool.map(lambda k: store.create("metadata/v1.json", str(k)), range(16)))
    assert sum(won) == 1 and store.read("metadata/v1.json") == str(won.index(True))
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.endswith(".tmp")]


def test_merge_evaluates_its_source_once(spark, table):
    source = rows(spark, (2, "new", 2), (9, "nine", 9)).withColumn("label", F.concat("label", F.lit("-"), F.uuid()))
    table.merge(source, ["id"], update={"label": "s.label"})
    got = dict(content(table))
    assert sorted(got) == [1, 2, 3, 9] and got[2].startswith("new-") and got[9].startswith("nine-")


def test_void_transform(spark, tmp_path):
    assert str(Transform.parse("void(id)")) == "void(id)"
    t = LakeTable.create(spark, f"file://{tmp_path}/v", SCHEMA, ["void(id)"])
    t.insert(rows(spark, (1, "a", 1), (2, "b", 2)))
    assert content(t) == [(1, "a"), (2, "b")] and len(t.plan_files([("id", "=", 1)])) >= 1


def test_maintenance_of_a_catalog(spark, tmp_path):
    from tarn.tables import LakeCatalog, Policy, maintain

    catalog = LakeCatalog(spark, f"file://{tmp_path}/c")
    busy, off = catalog.create("a", "busy", SCHEMA), catalog.create("a", "off", SCHEMA, properties={"maintenance.enabled": "false"})
    for k in range(6):
        busy.insert(rows(spark, (k, "x", 1)))
        off.insert(rows(spark, (k, "x", 1)))
    report = {r["name"]: r for r in maintain(catalog, Policy(expire_ms=0)).collect()}
    assert report["busy"]["compacted"] == 6 and report["busy"]["expired"] == 7 and report["busy"]["removed"] == 0 and report["busy"]["problem"] is None
    assert report["off"]["compacted"] is None
    assert [i for i, _ in content(busy)] == list(range(6)) and len(busy.state.current["files"]) == 1 and len(LakeTable(spark, off.path).state.current["files"]) == 6


def test_other_spellings_of_transforms():
    assert str(Transform.parse("date_trunc('month', day)")) == "month(day)" and str(Transform.parse("hash(4, id)")) == "bucket(4, id)"


def test_a_commit_writes_what_it_adds(spark, table, tmp_path):
    for k in range(4):
        table.insert(rows(spark, (40 + k, "m", 3)))
    written = table.store.read(f"metadata/v{table.state.version}.json")
    assert "data/" not in written and [len(s["manifests"]) for s in table.state.snapshots] == list(range(6))
    before = table.state.current["id"]
    table.compact(min_inputs=3)
    assert len(table.state.current["manifests"]) == 2 and len(table.state.current["files"]) == 3
    fresh = LakeTable(spark, table.path)
    assert [i for i, _ in content(fresh)] == [1, 2, 3, 40, 41, 42, 43] and fresh.scan(snapshot_id=before).count() == 7
    assert fresh.snapshots().orderBy("snapshot_id").collect()[-1]["files"] == 3
    fresh.expire_snapshots(0)
    old = time.time() - 5 * 86_400
    for path in (tmp_path / "t").rglob("*"):
        if path.is_file():
            os.utime(path, (old, old))
    assert fresh.remove_orphans() > 0 and [i for i, _ in content(table)] == [1, 2, 3, 40, 41, 42, 43]
    assert len(list((tmp_path / "t/data").rglob("*.parquet"))) == 3
    assert len(list((tmp_path / "t/metadata").glob("m-*.json"))) == 2
