import datetime as dt
import decimal

import pytest
import zstandard
from pyspark.sql import types as T

from tarn.sources import infer_csv_schema, infer_json_schema, read_files, write_files
from tarn.sources.formats import by_suffix, check_codec
from tarn.tables import LakeTable


def test_suffixes_and_codecs():
    assert by_suffix("a/b.csv.gz") == ("csv", "gzip") and by_suffix("x.ndjson") == ("json", "none") and by_suffix("dir") == (None, "none")
    assert check_codec("avro", None) == "null"
    with pytest.raises(ValueError, match="no compression"):
        check_codec("parquet", "lz4")


def test_csv_inference_lattice():
    s = infer_csv_schema(["a,b,c,d,e,f", "1,1.5,1e3,true,x,", "2,2,7,no,1,"])
    assert [f.dataType.typeName() for f in s] == ["long", "decimal", "double", "boolean", "string", "string"]
    with pytest.raises(ValueError, match="fields"):
        infer_csv_schema(["a,b", "1"])
    with pytest.raises(ValueError, match="unique"):
        infer_csv_schema(["a,a", "1,2"])


def test_json_inference_lattice():
    s = infer_json_schema(['{"a": 1, "b": 1.5, "c": null, "d": "x", "e": [1]}', "", '{"a": 2.5, "b": 1, "c": true, "d": 1, "f": 99999999999999999999}'])
    assert {f.name: f.dataType.typeName() for f in s} == {"a": "decimal", "b": "decimal", "c": "boolean", "d": "string", "e": "string", "f": "decimal"}


@pytest.mark.parametrize("codec", ["null", "deflate", "snappy", "zstd"])
def test_avro_round_trip(spark, tmp_path, codec):
    schema = T.StructType.fromDDL("b boolean, i int, l bigint, f float, d double, s string, y binary, day date, n decimal(12,3), t timestamp_ntz")
    values = [(True, -5, 2**40, 1.5, -2.25, "é,\"x\"\n", b"\0\xff", dt.date(1969, 12, 31), decimal.Decimal("-12.345"), dt.datetime(2024, 5, 6, 7, 8, 9, 123456)), (None,) * 10]
    df = spark.createDataFrame(values, schema)
    write_files(df, f"{tmp_path}/out", "avro", codec)
    back = read_files(spark, f"file://{tmp_path}/out", schema, "avro")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    only = read_files(spark, f"file://{tmp_path}/out", T.StructType.fromDDL("s string, missing int"), "avro")
    assert {r["s"] for r in only.collect()} == {"é,\"x\"\n", None} and {r["missing"] for r in only.collect()} == {None}
    with pytest.raises(ValueError, match="no mapping"):
        from tarn.sources.avro import _avro_type

        _avro_type(T.ShortType())


@pytest.mark.parametrize("codec", ["snappy", "none", "gzip", "zstd"])
def test_parquet_round_trip_and_admission(spark, tmp_path, codec):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    write_files(df, f"{tmp_path}/p", "parquet", codec)
    assert read_files(spark, f"{tmp_path}/p", df.schema, "parquet").count() == 2
    with pytest.raises(ValueError, match="declared"):
        read_files(spark, f"{tmp_path}/p", T.StructType.fromDDL("id bigint, s string"), "parquet")


def test_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "tab\there\\ and\nline"), (2, None), (3, "")], "id int, s string")
    write_files(df, f"{tmp_path}/t", "text")
    assert sorted(map(tuple, read_files(spark, f"{tmp_path}/t", df.schema, "text").collect())) == sorted(map(tuple, df.collect()))


def test_csv_nulls_and_header_match(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,s\n1,"x, ""y"""\n2,\n3,""\n')
    schema = T.StructType.fromDDL("id int, s string")
    assert sorted(map(tuple, read_files(spark, f"{tmp_path}/a.csv", schema).collect())) == [(1, 'x, "y"'), (2, None), (3, "")]
    assert dict(map(tuple, read_files(spark, f"{tmp_path}/a.csv", schema, force_null=("s",)).collect()))[3] is None
    assert dict(map(tuple, read_files(spark, f"{tmp_path}/a.csv", schema, force_not_null=("s",)).collect()))[2] == ""
    assert read_files(spark, f"{tmp_path}/a.csv").schema["id"].dataType == T.LongType()
    with pytest.raises(ValueError, match="header"):
        read_files(spark, f"{tmp_path}/a.csv", T.StructType.fromDDL("id int, other string"), header="match")


def test_json_errors_and_zstd(spark, tmp_path):
    lines = '{"a": 1, "s": "x"}\n\n{"a": 2}\n{bad\n'
    (tmp_path / "j.json.zst").write_bytes(zstandard.compress(lines.encode()))
    schema = T.StructType.fromDDL("a bigint, s string")
    got = read_files(spark, f"{tmp_path}/j.json.zst", schema, on_error="ignore").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="malformed JSON"):
        read_files(spark, f"{tmp_path}/j.json.zst", schema).collect()
    with pytest.raises(ValueError, match="on_error"):
        read_files(spark, f"{tmp_path}/x.csv", schema, on_error="ignore")


def test_import_into_a_table(spark, tmp_path):
    from tarn.sources import export_to, import_from

    table = LakeTable.create(spark, f"file://{tmp_path}/t", T.StructType.fromDDL("id int, s string"))
    (tmp_path / "in.csv").write_text("id,s\n1,a\n2,b\n")
    assert import_from(spark, table, f"{tmp_path}/in.csv") == 2
    assert export_to(table.scan(), f"{tmp_path}/out", kind="json") == 2
    assert read_files(spark, f"{tmp_path}/out", kind="json").count() == 2


def test_csv_of_zstd_keeps_rows_that_look_like_the_header(spark, tmp_path):
    (tmp_path / "z.csv.zst").write_bytes(zstandard.compress(b'id,s\n1,"a\nb"\nid,s\n2,\n3,""\n'))
    schema = T.StructType.fromDDL("id string, s string")
    got = sorted(map(tuple, read_files(spark, f"{tmp_path}/z.csv.zst", schema, header="match").collect()), key=str)
    assert got == [("1", "a\nb"), ("2", None), ("3", ""), ("id", "s")]


def test_csv_is_split_and_line_breaks_are_an_option(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id;s\n1;"a\nb"\n2;~\n')
    schema = T.StructType.fromDDL("id int, s string")
    assert sorted(map(tuple, read_files(spark, f"{tmp_path}/m.csv", schema, sep=";", null="~", multiline=True).collect())) == [(1, "a\nb"), (2, None)]
    (tmp_path / "big.csv").write_text("id,s\n" + "".join(f"{k},{'x' * 90}\n" for k in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        df = read_files(spark, f"{tmp_path}/big.csv", schema)
        assert df.count() == 40_000 and df.rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_copy_text_escapes(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1\t\\101\\x42\\q\\\\n\\n\n2\t\\N\n\\.\n")
    got = sorted(map(tuple, read_files(spark, f"{tmp_path}/e.txt", T.StructType.fromDDL("id int, s string")).collect()))
    assert got == [(1, "ABq\\n\n"), (2, None)]


def test_prefixes_read_files_of_their_format_only(spark, tmp_path):
    (tmp_path / "p/q").mkdir(parents=True)
    (tmp_path / "p/a.csv").write_text("id\n1\n")
    (tmp_path / "p/q/b.csv").write_text("id\n2\n")
    (tmp_path / "p/c.txt").write_text("no such thing")
    assert sorted(r[0] for r in read_files(spark, f"{tmp_path}/p", T.StructType.fromDDL("id int"), "csv").collect()) == [1, 2]


def test_files_near_a_target_size(spark, tmp_path):
    df = spark.range(0, 400_000, 1, 1).selectExpr("id", "sha2(string(id), 256) AS s")
    write_files(df, f"{tmp_path}/r", "parquet", "none", target_bytes=8 << 20)
    sizes = [p.stat().st_size for p in (tmp_path / "r").glob("*.parquet")]
    assert len(sizes) > 1 and max(sizes) < 16 << 20
    write_files(df, f"{tmp_path}/n", "text", max_records=100_000)
    assert len(list((tmp_path / "n").glob("*.txt"))) == 4


def test_avro_splits_meet_at_sync_markers(spark, tmp_path):
    from tarn.sources.avro import read_avro

    df = spark.range(0, 60_000, 1, 2).selectExpr("id", "sha2(string(id), 256) AS s", "id % 7 AS k")
    write_files(df, f"{tmp_path}/a", "avro", "deflate")
    for split in (32 << 20, 200_000, 70_000):
        back = read_avro(spark, f"file://{tmp_path}/a", T.StructType.fromDDL("id bigint, k bigint"), split)
        assert back.selectExpr("count(*)", "count(DISTINCT id)", "sum(id)", "sum(k)").first() == (60_000, 60_000, 60_000 * 59_999 // 2, sum(k % 7 for k in range(60_000)))


def test_avro_skips_nested_fields_and_resolves_names():
    import io
    import json
    import os

    from tarn.sources import avro

    point = {"type": "record", "name": "Point", "namespace": "a.b", "fields": [{"name": "x", "type": "int"}, {"name": "tags", "type": {"type": "map", "values": "string"}}]}
    schema = {"type": "record", "name": "r", "fields": [{"name": "p", "type": point}, {"name": "list", "type": {"type": "array", "items": "a.b.Point"}}, {"name": "f", "type": {"type": "fixed", "name": "F", "size": 3}}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["u", "v"]}}, {"name": "q", "type": ["null", "Point"]}, {"name": "n", "type": "long"}]}
    z, s = avro._zigzag, lambda t: avro._zigzag(len(t)) + t.encode()
    p = z(5) + z(1) + s("k") + s("value") + z(0)
    row = p + z(-1) + z(len(p)) + p + z(0) + b"abc" + z(1) + z(1) + p + z(42)
    sync = os.urandom(16)
    head = {"avro.schema": json.dumps(schema), "avro.codec": "null"}
    data = avro.MAGIC + z(2) + b"".join(s(k) + s(v) for k, v in head.items()) + b"\0" + sync + z(2) + z(2 * len(row)) + row * 2 + sync
    assert list(avro.decode_file(data, ["n", "missing"])) == [[42, None]] * 2
    want = {"x": 5, "tags": {"k": "value"}}
    assert list(avro.decode_file(data, ["q", "e", "list", "f", "p"])) == [[want, "v", [want], b"abc", want]] * 2
    with pytest.raises(ValueError, match="corrupt"):
        list(avro.decode_file(data[:-1] + b"?", ["n"]))
    assert avro.Container(io.BytesIO(data), ["n"]).codec == "null"


def test_analyze_and_truncate_files(spark, tmp_path):
    from tarn.sources import analyze_files, truncate_files

    write_files(spark.range(10).selectExpr("id", "CASE WHEN id < 5 THEN 'x' END AS s"), f"{tmp_path}/f", "csv")
    (tmp_path / "f/keep.txt").write_text("x")
    schema = T.StructType.fromDDL("id bigint, s string")
    got = {r["column"]: r for r in analyze_files(spark, f"{tmp_path}/f", fraction=1.0, schema=schema, kind="csv").collect()}
    assert (got["id"]["low"], got["id"]["high"], got["s"]["null_share"], got["s"]["distinct_values"]) == ("0", "9", 0.5, 1)
    assert truncate_files(spark, f"{tmp_path}/f", "csv") > 0 and (tmp_path / "f/keep.txt").exists()
    assert not list((tmp_path / "f").glob("*.csv"))
