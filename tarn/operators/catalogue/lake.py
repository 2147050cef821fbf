"""Queries through the lake table layer and the file connectors, over tables written from the driver's."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.plans.materialize import shared_dir
from tarn.registry import query, table
from tarn.sources import read_files, write_files
from tarn.tables import IcebergTable, LakeTable


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tarn-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _orders(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> LakeTable:
    return LakeTable.create_as(table(spark, sf_dir, "orders"), _scratch(spark, "orders"), partition_by=by or [])


@query("SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-06-01' GROUP BY o_orderstatus")
def lake_scan_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _orders(spark, sf_dir, ["year(o_orderdate)"])
    where = [("o_orderdate", ">=", dt.datetime(1995, 3, 1)), ("o_orderdate", "<", dt.datetime(1995, 6, 1))]
    return lake.scan(["o_orderstatus", "o_orderkey"], where).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE NOT (o_orderkey % 5 = 0)")
def lake_delete_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _orders(spark, sf_dir, ["o_orderstatus"])
    lake.delete(F.col("o_orderkey") % 5 == 0)
    lake.update([("o_orderstatus", "=", "O")], {"o_orderstatus": F.lit("open")})
    return lake.scan(["o_orderkey", "o_orderstatus"])


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders
       UNION ALL SELECT -o_orderkey, o_custkey + 1 FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey <> 0"""
)
def lake_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lake = _orders(spark, sf_dir)
    changed = orders.where("o_orderkey % 3 = 0").unionByName(orders.where("o_orderkey % 7 = 0 AND o_orderkey <> 0").withColumn("o_orderkey", -F.col("o_orderkey")))
    lake.merge(changed.withColumn("o_custkey", F.col("o_custkey") + 1), ["o_orderkey"], update={"o_custkey": "s.o_custkey"})
    return lake.scan(["o_orderkey", "o_custkey"])


@query("SELECT count(*) AS n FROM orders")
def lake_metadata_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_orders(spark, sf_dir).count(),)], "n bigint")


@query("SELECT n_nationkey, n_name AS title, CAST(NULL AS DOUBLE) AS extra FROM nation UNION ALL SELECT r_regionkey + 100, r_name, 1.5 FROM region")
def lake_schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    lake = LakeTable.create_as(table(spark, sf_dir, "nation"), _scratch(spark, "nation"))
    lake.rename_column("n_name", "title")
    lake.drop_column("n_regionkey")
    lake.add_column("extra", T.DoubleType())
    region = table(spark, sf_dir, "region")
    lake.insert(region.select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("title"), F.lit(1.5).alias("extra")))
    return lake.scan()


@query("SELECT n_nationkey, n_name FROM nation")
def lake_compaction_and_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lake = LakeTable.create_as(nation.where("n_nationkey < 5"), _scratch(spark, "small"))
    for k in range(5, 25, 4):
        lake.insert(nation.where(f"n_nationkey BETWEEN {k} AND {k + 3}"))
    before = lake.state.current["id"]
    lake.compact()
    lake.truncate()
    return lake.scan(snapshot_id=before)


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def connector_avro_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    path = _scratch(spark, "avro")
    write_files(part, path, "avro", "deflate")
    return read_files(spark, path, part.schema, "avro")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def connector_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = _scratch(spark, "csv")
    write_files(customer, path, "csv", "gzip")
    return read_files(spark, path, customer.schema, "csv")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def connector_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    path = _scratch(spark, "json")
    write_files(orders, path, "json")
    return read_files(spark, path, orders.schema, "json")


@query("SELECT event_id, props FROM events")
def connector_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "props")
    path = _scratch(spark, "text")
    write_files(events, path, "text")
    return read_files(spark, path, events.schema, "text")


@query("SELECT s_suppkey, s_name FROM supplier")
def connector_parquet_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    path = _scratch(spark, "parquet")
    write_files(supplier, path, "parquet", "zstd")
    return read_files(spark, path, supplier.schema, "parquet")


@query("SELECT n_nationkey + 100 AS n_nationkey, upper(n_name) AS n_name, 'inserted' AS what FROM nation WHERE n_nationkey < 7 UNION ALL SELECT n_nationkey, n_name, 'deleted' FROM nation WHERE n_nationkey % 3 = 0")
def lake_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lake = LakeTable.create_as(nation, _scratch(spark, "returning"))
    gone = lake.delete_returning(F.col("n_nationkey") % 3 == 0)
    fresh = lake.insert_returning(nation.where("n_nationkey < 7").select((F.col("n_nationkey") + 100).cast(nation.schema[0].dataType).alias("n_nationkey"), F.upper("n_name").alias("n_name")))
    return fresh.withColumn("what", F.lit("inserted")).unionByName(gone.withColumn("what", F.lit("deleted")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT -1 - o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 4 <> 0")
def lake_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of one transaction see one another, a rolled-back savepoint leaves nothing, and all is one commit."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lake = LakeTable.create_as(orders, _scratch(spark, "transaction"))
    with lake.transaction() as tx:
        tx.insert(orders.where("o_orderkey % 6 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey")))
        mark = tx.savepoint()
        tx.delete(F.col("o_orderkey") > 0)
        tx.rollback_to(mark)
        tx.delete((F.col("o_orderkey") % 4 == 0) & (F.col("o_orderkey") >= 0) | ((-1 - F.col("o_orderkey")) % 4 == 0) & (F.col("o_orderkey") < 0))
        tx.update((F.col("o_orderkey") % 11 == 0) & (F.col("o_orderkey") >= 0), {"o_orderstatus": F.lit("X")})
    return lake.scan()


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 1 OR o_orderkey % 2 = 0 AND o_orderstatus = 'F'")
def lake_partition_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two partition specs in one table, pruned each by its own."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    lake = LakeTable.create_as(orders.where("o_orderkey % 2 = 0"), _scratch(spark, "evolving"), partition_by=["year(o_orderdate)"])
    lake.replace_partition_spec(["o_orderstatus", "bucket(4, o_orderkey)"])
    lake.insert(orders.where("o_orderkey % 2 = 1"))
    return lake.scan(["o_orderkey", "o_orderstatus"], [("o_orderstatus", "=", "F")])


@query("SELECT count(*) AS n, (SELECT count(*) FROM orders) AS total FROM orders WHERE o_orderkey % 10 <> 0")
def lake_count_with_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _orders(spark, sf_dir)
    before = lake.count()
    lake.delete(F.col("o_orderkey") % 10 == 0)
    return spark.createDataFrame([(lake.count(), before)], "n bigint, total bigint")


@query(
    """WITH t AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 5 <> 0 THEN n_regionkey END AS n_regionkey FROM nation)
       SELECT 'n_name' AS "column", avg((n_name IS NULL)::INT) AS null_share, min(n_name) AS low, max(n_name) AS high FROM t
       UNION ALL SELECT 'n_nationkey', avg((n_nationkey IS NULL)::INT), min(n_nationkey)::VARCHAR, max(n_nationkey)::VARCHAR FROM t
       UNION ALL SELECT 'n_regionkey', avg((n_regionkey IS NULL)::INT), min(n_regionkey)::VARCHAR, max(n_regionkey)::VARCHAR FROM t"""
)
def lake_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.tables.catalog import analyze

    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_regionkey")).alias("n_regionkey"))
    return analyze(LakeTable.create_as(nation, _scratch(spark, "analyzed")), fraction=1.0).select("column", "null_share", "low", "high")


@query("SELECT n_nationkey, n_name || ';\"' || chr(10) || 'x' AS n_name, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey END AS n_regionkey FROM nation")
def connector_csv_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another separator and null string, quotes, separators and line breaks inside quotes, a checked header."""
    nation = table(spark, sf_dir, "nation")
    odd = nation.select("n_nationkey", F.concat("n_name", F.lit(';"\nx')).alias("n_name"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")).alias("n_regionkey"))
    path = _scratch(spark, "csv-options")
    write_files(odd, path, "csv", sep=";", null="~")
    return read_files(spark, path, odd.schema, "csv", sep=";", null="~", header="match", multiline=True)


@query("SELECT * FROM (VALUES ('another type', TRUE), ('malformed record', TRUE), ('missing column', TRUE), ('no such codec', TRUE), ('wrong header', TRUE)) t(what, refused)")
def connector_admission_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that do not fit their declaration are refused."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    parquet, csv, json = (_scratch(spark, k) for k in ("parquet", "csv", "json"))
    write_files(supplier, parquet, "parquet")
    write_files(supplier, csv, "csv")
    write_files(supplier.select(F.lit("{bad").alias("value")), json, "text")
    cases = {
        "another type": lambda: read_files(spark, parquet, supplier.select(F.col("s_suppkey").cast("string"), "s_name").schema, "parquet"),
        "missing column": lambda: read_files(spark, parquet, supplier.withColumn("other", F.lit(1)).schema, "parquet"),
        "wrong header": lambda: read_files(spark, csv, supplier.toDF("a", "b").schema, "csv", header="match"),
        "malformed record": lambda: read_files(spark, json, supplier.schema, "json", match_suffix=False).count(),
        "no such codec": lambda: write_files(supplier, parquet, "parquet", "lz4"),
    }

    def refused(run) -> bool:
        try:
            run()
        except Exception as error:
            return any(x in str(error) for x in ("declared", "header", "malformed", "no compression"))
        return False

    return spark.createDataFrame([(what, refused(run)) for what, run in cases.items()], "what string, refused boolean")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0")
def connector_json_skips_bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    path = _scratch(spark, "json-ignore")
    lines = supplier.select(F.when(F.col("s_suppkey") % 2 == 0, F.to_json(F.struct("s_suppkey", "s_name"))).otherwise(F.lit("{not json")).alias("value"))
    write_files(lines, path, "text")
    return read_files(spark, path, supplier.schema, "json", on_error="ignore", match_suffix=False)


@query("SELECT l_orderkey, l_linenumber, l_comment_like AS note FROM (SELECT l_orderkey, l_linenumber, l_returnflag || chr(9) || '\\' || l_linestatus AS l_comment_like FROM lineitem) t")
def connector_copy_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY TO text files and COPY FROM into a table, with escapes; the counts of both must agree."""
    from pyspark.sql import types as T

    from tarn.sources import export_to, import_from

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.lit("\t\\"), "l_linestatus").alias("note"))
    path = _scratch(spark, "copy")
    lake = LakeTable.create(spark, _scratch(spark, "copied"), T.StructType(rows.schema.fields))
    if export_to(rows, path, kind="text") != import_from(spark, lake, path, kind="text"):
        raise RuntimeError("COPY lost rows")
    return lake.scan()


def _iceberg(spark: SparkSession, sf_dir: str) -> IcebergTable:
    """orders in the Apache Iceberg format, appended in two halves by key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    made = IcebergTable.create(spark, _scratch(spark, "iceberg"), orders.schema)
    middle = orders.agg(F.max("o_orderkey")).first()[0] // 2
    made.append(orders.where(F.col("o_orderkey") <= middle))
    made.append(orders.where(F.col("o_orderkey") > middle))
    return made


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderstatus = 'O'")
def iceberg_position_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _iceberg(spark, sf_dir)
    made.delete_where((F.col("o_orderkey") % 7 == 0) & (F.col("o_orderstatus") != "O"))
    return made.scan().withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 2000 GROUP BY o_orderstatus")
def iceberg_pruned_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _iceberg(spark, sf_dir)
    before = made.snapshot()["snapshot-id"]
    made.overwrite(table(spark, sf_dir, "orders").limit(0).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"))
    found = made.scan(["o_orderstatus", "o_orderkey"], [("o_orderkey", ">", 100), ("o_orderkey", "<=", 2000)], snapshot_id=before)
    return found.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("SELECT count(*) AS n FROM orders")
def iceberg_metadata_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_iceberg(spark, sf_dir).count(),)], "n bigint")
