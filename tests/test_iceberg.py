import datetime as dt
import decimal
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.sources.avro import decode_file, encode_file
from tarn.tables import CommitConflict, IcebergTable
from tarn.tables import iceberg as I

KINDS = {"id": T.LongType(), "label": T.StringType(), "day": T.DateType(), "price": T.DecimalType(12, 2), "at": T.TimestampType(), "x": T.DoubleType(), "ok": T.BooleanType()}
SCHEMA = T.StructType([T.StructField(n, k) for n, k in KINDS.items()])


def rows(spark, *ids):
    values = [(i, f"label {i}", dt.date(2024, 1, 1 + i % 28), decimal.Decimal(f"{i}.25"), dt.datetime(2024, 1, 1 + i % 28, 12), i / 3, i % 2 == 0) for i in ids]
    return spark.createDataFrame(values, SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    t = IcebergTable.create(spark, f"file://{tmp_path}/t", SCHEMA)
    t.append(rows(spark, 1, 2, 3).coalesce(1))
    t.append(rows(spark, 10, 11).coalesce(1))
    return t


def metadata(table):
    return json.loads(table.store.read(f"metadata/v{table.version}.metadata.json"))


def publish(table, meta):
    assert table.store.create(f"metadata/v{table.version + 1}.metadata.json", json.dumps(meta))
    table.refresh()


def test_append_scan_and_prune(spark, table):
    assert table.count() == 5 and ids(table.scan()) == [1, 2, 3, 10, 11]
    assert sorted(map(tuple, table.scan().collect())) == sorted(map(tuple, rows(spark, 1, 2, 3, 10, 11).collect()))
    for where, n in [([("id", ">", 5)], 1), ([("id", "=", 3)], 1), ([("id", "in", [2, 10])], 2), ([("label", ">=", "label 3")], 1), ([("price", "<", decimal.Decimal("2.00"))], 1), ([("label", "is null", None)], 0), ([("at", ">", dt.datetime(2024, 1, 9))], 1), ([("day", "<", dt.date(2024, 1, 5))], 1)]:
        assert len(table.plan_files(where)) == n, where
        predicate = I.condition(where[0])
        assert ids(table.scan(["id"], where)) == ids(rows(spark, 1, 2, 3, 10, 11).where(predicate))


def test_position_deletes_and_time_travel(spark, table):
    before = table.snapshot()["snapshot-id"]
    assert table.delete_where(F.col("id").isin(2, 10)) == 2 and table.delete_where(F.col("id") == 99) == 0
    table.append(rows(spark, 2))
    assert ids(table.scan()) == [1, 2, 3, 11] and table.count() == 4
    assert table.delete_where(F.col("id") == 2) == 1 and ids(table.scan()) == [1, 3, 11]
    assert ids(table.scan(snapshot_id=before)) == [1, 2, 3, 10, 11]
    assert table.overwrite(rows(spark, 50)) == 1 and ids(table.scan()) == [50]
    first = table.meta["snapshots"][0]["timestamp-ms"]
    assert ids(table.scan(as_of=dt.datetime.fromtimestamp((first + 1) / 1000))) in ([1, 2, 3], [1, 2, 3, 10, 11])
    with pytest.raises(ValueError, match="so early"):
        table.scan(as_of=dt.datetime(2000, 1, 1))
    assert [r["operation"] for r in table.snapshots().orderBy("committed_ms").collect()] == ["append", "append", "delete", "append", "delete", "overwrite"]


def test_columns_are_matched_by_id(spark, table):
    meta = metadata(table)
    fields = json.loads(json.dumps(meta["schemas"][0]["fields"]))
    fields[1]["name"] = "title"
    fields = [f for f in fields if f["name"] != "x"] + [{"id": 8, "name": "label", "required": False, "type": "string"}]
    meta["schemas"].append({"type": "struct", "schema-id": 1, "fields": fields})
    meta |= {"current-schema-id": 1, "last-column-id": 8}
    publish(table, meta)
    got = {r["id"]: (r["title"], r["label"]) for r in table.scan().collect()}
    assert got[3] == ("label 3", None) and "x" not in table.schema.names
    assert table.scan(snapshot_id=table.snapshot()["snapshot-id"]).columns == SCHEMA.names
    table.append(rows(spark, 20).withColumnRenamed("label", "title").withColumn("label", F.lit("new")))
    assert {r["id"]: r["label"] for r in table.scan().collect()}[20] == "new"


def test_equality_deletes_reach_older_data_only(spark, table):
    kind = T.StructType([f for f in table.schema if f.name in ("label", "day")])
    gone = rows(spark, 2, 11, 77).select("label", "day").unionByName(spark.createDataFrame([("label 1", None)], "label string, day date"))
    files = [f | {"equality_ids": [2, 3]} for f in table._write_files(gone, I.EQUALITY_DELETES, kind)]
    table._commit("delete", [], files, False)
    table.append(rows(spark, 2))
    assert ids(table.scan()) == [1, 2, 3, 10] and table.count() == 4


def test_version_1_metadata_and_partitions(spark, table):
    meta = metadata(table)
    day = lambda n: (dt.date(2024, 1, n) - dt.date(1970, 1, 1)).days
    partition = I._record("r102", [("day_day", 1000, ["null", "int"]), ("label", 1001, ["null", "string"])])
    fields = [f for f in I.DATA_FILE["fields"] if f["name"] not in ("content", "equality_ids", "lower_bounds", "upper_bounds")]
    data_file = I.DATA_FILE | {"fields": [f | {"type": partition} if f["name"] == "partition" else f for f in fields]}
    schema = I._record("manifest_entry", [("status", 0, "int"), ("snapshot_id", 1, ["null", "long"]), ("data_file", 2, data_file)])
    files = table.plan_files()
    entries = [{"status": I.DELETED if k == 2 else I.ADDED, "snapshot_id": 7, "data_file": f.raw | {"partition": {"day_day": day(4 if k else 2), "label": None if k else "a"}}} for k, f in enumerate([*files, files[0]])]
    table.store.write_bytes("metadata/one.avro", encode_file(schema, entries))
    meta = {k: v for k, v in meta.items() if k not in ("schemas", "snapshots", "last-sequence-number")} | {"format-version": 1, "schema": meta["schemas"][0], "current-snapshot-id": 7}
    meta["partition-specs"] = [{"spec-id": 0, "fields": [{"source-id": 3, "field-id": 1000, "name": "day_day", "transform": "day"}, {"source-id": 2, "field-id": 1001, "name": "label", "transform": "identity"}]}]
    meta["snapshots"] = [{"snapshot-id": 7, "timestamp-ms": 1, "manifests": [f"{table.path}/metadata/one.avro"]}]
    publish(table, meta)
    assert table.count() == 5 and ids(table.scan()) == [1, 2, 3, 10, 11]
    assert len(table.plan_files([("day", "=", dt.date(2024, 1, 4))])) == 1 and len(table.plan_files([("day", ">", dt.date(2024, 1, 5))])) == 0
    assert len(table.plan_files([("label", "=", "b")])) == 1 and len(table.plan_files([("label", "is null", None)])) == 0


def test_writers_at_the_same_time(spark, table):
    handles = [IcebergTable(spark, table.path) for _ in range(5)]
    files = [h._write_files(rows(spark, 100 + k), I.DATA, h.schema) for k, h in enumerate(handles)]
    with ThreadPoolExecutor(5) as pool:
        list(pool.map(lambda k: handles[k]._commit("append", files[k], [], False), range(5)))
    table.refresh()
    assert ids(table.scan()) == [1, 2, 3, 10, 11, *range(100, 105)]
    stale = IcebergTable(spark, table.path)
    table.append(rows(spark, 200))
    with pytest.raises(CommitConflict):
        stale.delete_where(F.col("id") == 1)


def test_empty_and_unsupported_tables(spark, tmp_path):
    t = IcebergTable.create(spark, f"file://{tmp_path}/e", SCHEMA)
    assert t.count() == 0 and t.scan().collect() == [] and t.snapshot() is None
    with pytest.raises(ValueError, match="exists"):
        IcebergTable.create(spark, f"file://{tmp_path}/e", SCHEMA)
    with pytest.raises(ValueError, match="no table"):
        IcebergTable(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="no type"):
        I.spark_type("variant")
    nested = {"type": "struct", "fields": [{"id": 1, "name": "a", "required": True, "type": {"type": "list", "element-id": 2, "element": "int", "element-required": True}}, {"id": 3, "name": "m", "required": False, "type": {"type": "map", "key-id": 4, "key": "string", "value-id": 5, "value": "double", "value-required": False}}]}
    assert I.spark_type(nested).simpleString() == "struct<a:array<int>,m:map<string,double>>"


def test_bounds_and_container_files():
    for kind, value in [("int", -5), ("long", 2**40), ("double", 1.5), ("date", dt.date(1969, 5, 1)), ("timestamp", dt.datetime(2024, 5, 6, 7, 8, 9, 10)), ("boolean", True), ("string", "é"), ("decimal(9, 2)", decimal.Decimal("-12.34"))]:
        assert I.bound_value(kind, I._bound(kind, value)) == value
    assert I._bound("double", float("nan")) is None and I.bound_value("int", None) is None
    records = [{"status": 1, "snapshot_id": None, "sequence_number": 5, "file_sequence_number": None, "data_file": {"content": 0, "file_path": "p", "file_format": "PARQUET", "partition": {}, "record_count": 3, "file_size_in_bytes": 9, "null_value_counts": [{"key": 1, "value": 0}], "lower_bounds": [], "upper_bounds": None, "equality_ids": [1, 2]}}]
    back = list(decode_file(encode_file(I.MANIFEST, records), ["status", "snapshot_id", "sequence_number", "data_file"]))
    assert back == [[1, None, 5, records[0]["data_file"]]]


def test_sqlite_catalog(spark, tmp_path):
    from tarn.tables import SqliteCatalog

    catalog = SqliteCatalog(spark, f"{tmp_path}/catalog.db", "main", f"file://{tmp_path}/warehouse")
    made = catalog.create("sales.eu", "t", SCHEMA)
    made.append(rows(spark, 1, 2, 3))
    other = SqliteCatalog(spark, f"{tmp_path}/catalog.db", "main", f"file://{tmp_path}/warehouse").load("sales.eu", "t")
    other.append(rows(spark, 4))
    made.append(rows(spark, 5))  # rebases on the other's commit
    other.refresh()
    assert ids(made.scan()) == [1, 2, 3, 4, 5] == ids(other.scan())
    made.delete_where(F.col("id") == 2)
    with pytest.raises(CommitConflict):
        other.delete_where(F.col("id") == 3)
    assert ids(catalog.load("sales.eu", "t").scan()) == [1, 3, 4, 5]
    assert catalog.namespaces() == ["sales.eu"] and catalog.tables("sales.eu") == ["t"] and catalog.tables("none") == []
    with pytest.raises(ValueError, match="exists"):
        catalog.create("sales.eu", "t", SCHEMA)
    catalog.rename("sales.eu", "t", "sales.us", "u")
    views = catalog.import_schema("sales.us")
    assert set(views) == {"u"} and spark.sql("SELECT count(*) FROM u").first()[0] == 4
    catalog.drop("sales.us", "u")
    with pytest.raises(ValueError, match="no table"):
        catalog.load("sales.us", "u")


class Rest:
    """A REST catalog over one in-memory table, by the published protocol."""

    def __init__(self, meta):
        import http.server
        import threading

        rest = self
        self.meta, self.seen = meta, []

        class Handler(http.server.BaseHTTPRequestHandler):
            def answer(self, code, body):
                data = json.dumps(body).encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self):
                rest.seen.append((self.path, self.headers.get("Authorization")))
                if self.path.startswith("/v1/config"):
                    return self.answer(200, {"defaults": {}, "overrides": {"prefix": "w"}})
                known = {"/v1/w/namespaces": {"namespaces": [["a", "b"]]}, "/v1/w/namespaces/a%1Fb/tables": {"identifiers": [{"namespace": ["a", "b"], "name": "t"}]}, "/v1/w/namespaces/a%1Fb/tables/t": {"metadata-location": "m", "metadata": rest.meta}}
                return self.answer(200, known[self.path]) if self.path in known else self.answer(404, {"error": {"message": "no such table"}})

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                wanted = next(r["snapshot-id"] for r in body["requirements"] if r["type"] == "assert-ref-snapshot-id")
                if wanted != rest.meta["refs"].get("main", {}).get("snapshot-id"):
                    return self.answer(409, {"error": {"message": "changed"}})
                snapshot = next(u["snapshot"] for u in body["updates"] if u["action"] == "add-snapshot")
                rest.meta = rest.meta | {"snapshots": [*rest.meta["snapshots"], snapshot], "current-snapshot-id": snapshot["snapshot-id"], "last-sequence-number": snapshot["sequence-number"], "refs": {"main": {"snapshot-id": snapshot["snapshot-id"], "type": "branch"}}}
                return self.answer(200, {"metadata-location": "m", "metadata": rest.meta})

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.uri = f"http://127.0.0.1:{self.server.server_port}"


def test_rest_catalog(spark, tmp_path):
    from tarn.tables import RestCatalog

    rest = Rest(I.new_metadata(f"file://{tmp_path}/r", SCHEMA))
    try:
        catalog = RestCatalog(spark, rest.uri, warehouse="w", token="secret")
        assert catalog.namespaces() == ["a.b"] and catalog.tables("a.b") == ["t"]
        first, second = catalog.load("a.b", "t"), catalog.load("a.b", "t")
        first.append(rows(spark, 1, 2))
        second.append(rows(spark, 3))
        first.refresh()
        assert ids(first.scan()) == [1, 2, 3] and all(token == "Bearer secret" for _, token in rest.seen)
        first.delete_where(F.col("id") == 1)
        with pytest.raises(CommitConflict):
            second.delete_where(F.col("id") == 2)
        with pytest.raises(ValueError, match="no such table"):
            catalog.load("a.b", "none")
        with pytest.raises(ValueError, match="options"):
            RestCatalog(spark, rest.uri, wharehouse="w")
    finally:
        rest.server.shutdown()
