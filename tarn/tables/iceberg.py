"""Tables in the Apache Iceberg format (versions 1 and 2), by its published specification and without a JVM package.

Metadata JSON, manifest lists and manifests are small and read by the driver, manifests of a snapshot in parallel; data
files are read by Spark with columns matched by field id, so renames, drops and additions need no rewriting. Position
deletes are anti-joined by file and row index, equality deletes by their columns, each only against older data files.
Files are pruned by partition values and column bounds before the reader is built.

Writing: ``create``, ``append``, ``delete_where`` (position deletes) and ``overwrite`` for unpartitioned tables. The newest
metadata is found and replaced by a catalog: the table's directory (``DirectoryCatalog``), or one of ``catalogs``. Each
replaces only the state that the writer has seen, so of writers at the same time one commits and the others rebase or
fail.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re
import struct
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.sources.avro import decode_file, encode_file
from tarn.tables.files import Store
from tarn.tables.lake import CommitConflict, Predicate, condition
from tarn.tables.transforms import Transform

DATA, POSITION_DELETES, EQUALITY_DELETES = 0, 1, 2
EXISTING, ADDED, DELETED = 0, 1, 2
#: Field ids of the columns of position delete files.
DELETE_PATH, DELETE_POS = 2147483546, 2147483545
_READ_BY_ID = {"spark.sql.parquet.fieldId.read.enabled": "true", "spark.sql.parquet.fieldId.read.ignoreMissing": "true"}
# Primitive types of the format.
_TYPES = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "time": T.LongType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "string": T.StringType(), "uuid": T.BinaryType(), "binary": T.BinaryType()}


def spark_type(kind: object) -> T.DataType:
    """A type of the format as Spark's, with field ids."""
    if isinstance(kind, str):
        if found := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", kind):
            return T.DecimalType(int(found[1]), int(found[2]))
        if kind.startswith("fixed["):
            return T.BinaryType()
        if kind not in _TYPES:
            raise ValueError(f"no type for {kind}")
        return _TYPES[kind]
    if kind["type"] == "struct":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"]), not f["required"], {"parquet.field.id": f["id"]}) for f in kind["fields"]])
    if kind["type"] == "list":
        return T.ArrayType(spark_type(kind["element"]), not kind["element-required"])
    return T.MapType(spark_type(kind["key"]), spark_type(kind["value"]), not kind["value-required"])


def format_type(kind: T.DataType) -> str:
    """A Spark type as a primitive type of the format."""
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision}, {kind.scale})"
    for name, own in _TYPES.items():
        if own == kind and name not in ("time", "uuid"):
            return name
    raise ValueError(f"the format has no type for {kind.simpleString()}")


def bound_value(kind: str, data: bytes | None) -> object:
    """A single-value bound, comparable with a predicate's value; None if it says nothing."""
    if data is None:
        return None
    codes = {"int": "<i", "long": "<q", "float": "<f", "double": "<d", "date": "<i", "timestamp": "<q", "timestamptz": "<q"}
    if kind in codes:
        value = struct.unpack(codes[kind] if len(data) == struct.calcsize(codes[kind]) else "<i", data)[0]
        if kind == "date":
            return dt.date(1970, 1, 1) + dt.timedelta(days=value)
        return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=value) if kind.startswith("timestamp") else value
    if kind == "boolean":
        return data != b"\0"
    if kind == "string":
        return data.decode("utf-8", "ignore")
    if found := re.fullmatch(r"decimal\(\d+,\s*(\d+)\)", kind):
        return decimal.Decimal(int.from_bytes(data, "big", signed=True)).scaleb(-int(found[1]))
    return None


def _bound(kind: str, value: object) -> bytes | None:
    codes = {"int": "<i", "long": "<q", "float": "<f", "double": "<d"}
    if value is None or (isinstance(value, float) and value != value):
        return None
    if kind in codes:
        return struct.pack(codes[kind], value)
    if kind == "date":
        return struct.pack("<i", (value - dt.date(1970, 1, 1)).days)
    if kind.startswith("timestamp"):
        return struct.pack("<q", round((value.replace(tzinfo=None) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)))
    if kind == "boolean":
        return b"\1" if value else b"\0"
    if kind == "string":
        return value.encode()
    if found := re.fullmatch(r"decimal\(\d+,\s*(\d+)\)", kind):
        n = int(value.scaleb(int(found[1])))
        return n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True)
    return None


@dataclass
class File:
    """A data or delete file of a snapshot."""

    content: int
    path: str
    rows: int
    size: int
    sequence: int
    spec: int
    partition: dict[str, object]
    lower: dict[int, bytes]
    upper: dict[int, bytes]
    nulls: dict[int, int]
    equality_ids: list[int]
    raw: dict


def _pairs(entries: list[dict] | dict | None) -> dict:
    return {e["key"]: e["value"] for e in entries} if isinstance(entries, list) else entries or {}


def _spelled(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


class DirectoryCatalog:
    """One table in a directory that holds its own metadata: ``vN.metadata.json`` and a version hint."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self.store = path.rstrip("/"), Store(spark, path)

    def load(self) -> tuple[object, dict]:
        """(what names the state, newest metadata): by the largest number in a metadata file's name."""
        names = [p.rsplit("/", 1)[1] for p, _, _ in self.store.list("metadata") if p.endswith(".metadata.json")]
        numbered = [(int(found[1]), n) for n in names if (found := re.match(r"v?(\d+)[.-]", n))]
        if not numbered:
            raise ValueError(f"no table at {self.path}")
        version, name = max(numbered)
        return version, json.loads(self.store.read(f"metadata/{name}"))

    def swap(self, state: int, meta: dict, snapshot: dict) -> bool:
        """Publish ``meta`` in place of ``state``; False if another writer was first."""
        if not self.store.create(f"metadata/v{state + 1}.metadata.json", json.dumps(meta)):
            return False
        self.store.replace("metadata/version-hint.text", str(state + 1))
        return True


class IcebergTable:
    def __init__(self, spark: SparkSession, path: str | None = None, catalog: object | None = None) -> None:
        """The table in a directory, or the one that ``catalog`` (with ``load`` and ``swap``) stands for."""
        self.spark, self.catalog = spark, catalog or DirectoryCatalog(spark, path)
        self.path = path.rstrip("/") if path else ""
        self.refresh()

    # -- metadata

    def refresh(self) -> None:
        self.state, self.meta = self.catalog.load()
        # A directory may be known by another name than where it was made; a catalog says where the table is.
        self.path = self.path or self.meta["location"].rstrip("/")
        self.store = Store(self.spark, self.path)
        self._manifests: dict[str, list[File]] = {}

    @property
    def version(self) -> object:
        return self.state

    def _schema_json(self, snapshot: dict | None = None) -> dict:
        if "schemas" not in self.meta:
            return self.meta["schema"]
        wanted = (snapshot or {}).get("schema-id", self.meta["current-schema-id"])
        return next(s for s in self.meta["schemas"] if s["schema-id"] == wanted)

    @property
    def schema(self) -> T.StructType:
        return spark_type({"type": "struct", "fields": self._schema_json()["fields"]})

    def snapshot(self, snapshot_id: int | None = None, as_of: dt.datetime | None = None) -> dict | None:
        """The snapshot named, that of a time, or the current one; None if the table has none."""
        found = self.meta.get("snapshots", [])
        if as_of is not None:
            older = [s for s in found if s["timestamp-ms"] <= as_of.timestamp() * 1000]
            if not older:
                raise ValueError("no snapshot so early")
            return max(older, key=lambda s: s["timestamp-ms"])
        wanted = self.meta.get("current-snapshot-id") if snapshot_id is None else snapshot_id
        if wanted in (None, -1):
            return None
        for s in found:
            if s["snapshot-id"] == wanted:
                return s
        raise ValueError(f"no snapshot {wanted}")

    def snapshots(self) -> DataFrame:
        rows = [(s["snapshot-id"], s.get("parent-snapshot-id"), s["timestamp-ms"], s.get("summary", {}).get("operation")) for s in self.meta.get("snapshots", [])]
        return self.spark.createDataFrame(rows, "snapshot_id bigint, parent_id bigint, committed_ms bigint, operation string")

    def _bytes(self, path: str) -> bytes:
        own = _spelled(path)
        base = _spelled(self.path)
        return self.store.read_bytes(own.removeprefix(base + "/")) if own.startswith(base + "/") else self.store.read_bytes(path, absolute=True)

    def _files(self, manifest: dict) -> list[File]:
        if manifest["manifest_path"] not in self._manifests:
            out = []
            for status, sequence, file in decode_file(self._bytes(manifest["manifest_path"]), ["status", "sequence_number", "data_file"]):
                if status == DELETED:
                    continue
                if file["file_format"].upper() != "PARQUET":
                    raise ValueError(f"files of format {file['file_format']} are not supported")
                if file.get("content_offset") is not None:
                    raise ValueError("deletion vectors are not supported")
                # An added file without a number has its manifest's; files of version 1 have 0.
                number = sequence if sequence is not None else manifest.get("sequence_number") or 0
                out.append(File(file.get("content") or DATA, file["file_path"], file["record_count"], file["file_size_in_bytes"], number, manifest["partition_spec_id"], file["partition"] or {}, _pairs(file.get("lower_bounds")), _pairs(file.get("upper_bounds")), _pairs(file.get("null_value_counts")), file.get("equality_ids") or [], file))
            self._manifests[manifest["manifest_path"]] = out
        return self._manifests[manifest["manifest_path"]]

    def manifests(self, snapshot: dict | None) -> list[dict]:
        if snapshot is None:
            return []
        if "manifest-list" not in snapshot:  # version 1 may list manifests in place
            return [{"manifest_path": p, "partition_spec_id": 0} for p in snapshot["manifests"]]
        names = ["manifest_path", "manifest_length", "partition_spec_id", "content", "sequence_number", "min_sequence_number", "added_snapshot_id", "added_files_count", "existing_files_count", "deleted_files_count", "added_rows_count", "existing_rows_count", "deleted_rows_count"]
        return [dict(zip(names, row, strict=True)) for row in decode_file(self._bytes(snapshot["manifest-list"]), names)]

    def all_files(self, snapshot: dict | None) -> list[File]:
        with ThreadPoolExecutor(8) as pool:
            return [f for files in pool.map(self._files, self.manifests(snapshot)) for f in files]

    # -- pruning

    def _field(self, column: str) -> dict | None:
        return next((f for f in self._schema_json()["fields"] if f["name"] == column), None)

    def _may_hold(self, file: File, predicate: Predicate) -> bool:
        column, op, value = predicate
        if op == "in":
            return any(self._may_hold(file, (column, "=", v)) for v in value)
        field = self._field(column)
        if field is None or not isinstance(field["type"], str):
            return True
        if not self._partition_may_hold(file, field, op, value):
            return False
        nulls = file.nulls.get(field["id"])
        if op == "is null":
            return nulls is None or nulls > 0
        if nulls is not None and nulls == file.rows:
            return False
        low, high = (bound_value(field["type"], b.get(field["id"])) for b in (file.lower, file.upper))
        if op == "is not null" or low is None or high is None:
            return True
        if isinstance(low, dt.datetime) and isinstance(value, dt.date):
            value = value.replace(tzinfo=None) if isinstance(value, dt.datetime) else dt.datetime.combine(value, dt.time())
        # An upper bound of text may be cut short: what it stands for can be larger.
        beyond = isinstance(high, str) and isinstance(value, str) and value.startswith(high)
        try:
            return {"=": low <= value and (value <= high or beyond), "<": low < value, "<=": low <= value, ">": high > value or beyond, ">=": high >= value or beyond, "<>": True}[op]
        except TypeError:
            return True

    def _partition_may_hold(self, file: File, field: dict, op: str, value: object) -> bool:
        specs = {s["spec-id"]: s["fields"] for s in self.meta.get("partition-specs", [])}
        for part in specs.get(file.spec, []):
            if part["source-id"] != field["id"] or part["name"] not in file.partition:
                continue
            stored, kind = file.partition[part["name"]], part["transform"]
            if kind == "identity":
                if op == "=" and not isinstance(stored, bytes | dt.date) and type(stored) is type(value) and stored != value:
                    return False
                if op == "is null" and stored is not None:
                    return False
            elif kind in ("year", "month", "day", "hour") and stored is not None and isinstance(value, dt.date):
                text = {"year": lambda n: f"{1970 + n:04d}", "month": lambda n: f"{1970 + n // 12:04d}-{n % 12 + 1:02d}", "day": lambda n: (n if isinstance(n, dt.date) else dt.date(1970, 1, 1) + dt.timedelta(days=n)).isoformat(), "hour": lambda n: (dt.datetime(1970, 1, 1) + dt.timedelta(hours=n)).strftime("%Y-%m-%d-%H")}[kind](stored)
                if not Transform(kind, field["name"]).may_match(text, op, value):
                    return False
        return True

    def plan_files(self, where: list[Predicate] | None = None, snapshot: dict | None = None) -> list[File]:
        return [f for f in self.all_files(snapshot or self.snapshot()) if f.content == DATA and all(self._may_hold(f, p) for p in where or [])]

    # -- reading

    def _read(self, schema: T.StructType, paths: list[str], with_position: bool) -> DataFrame:
        for key, value in _READ_BY_ID.items():
            self.spark.conf.set(key, value)
        df = self.spark.read.schema(schema).parquet(*paths)
        return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos")) if with_position else df

    def _rows(self, files: list[File], deletes: list[File], schema: T.StructType, keep_position: bool = False) -> DataFrame:
        empty = self.spark.createDataFrame([], T.StructType([*schema.fields, *([T.StructField("_file", T.StringType()), T.StructField("_pos", T.LongType())] if keep_position else [])]))
        if not files:
            return empty
        position = [d for d in deletes if d.content == POSITION_DELETES]
        equality = [d for d in deletes if d.content == EQUALITY_DELETES]
        oldest_delete = max((d.sequence for d in deletes), default=-1)
        # Deletes reach data of their own commit and before (positions), or before it (equality).
        dirty = [f for f in files if any(d.sequence >= f.sequence for d in position) or any(d.sequence > f.sequence for d in equality)] if oldest_delete >= 0 else []
        known = {f.path for f in dirty}
        clean = [f.path for f in files if f.path not in known]
        parts = [self._read(schema, clean, keep_position)] if clean else []
        if dirty:
            rows = self._read(schema, [f.path for f in dirty], True)
            plain = F.regexp_replace("_file", "^file:/+", "/")
            numbers = self.spark.createDataFrame([(_spelled(f.path), f.sequence) for f in dirty], "_path string, _sequence bigint")
            rows = rows.withColumn("_own", plain).join(numbers, F.col("_own") == F.col("_path")).drop("_path")
            if position:
                kind = T.StructType([T.StructField("file_path", T.StringType(), True, {"parquet.field.id": DELETE_PATH}), T.StructField("pos", T.LongType(), True, {"parquet.field.id": DELETE_POS})])
                gone = self._delete_rows(position, kind).select(F.regexp_replace("file_path", "^file:/+", "/").alias("_gone"), F.col("pos").alias("_at"), "_number")
                rows = rows.join(gone, (F.col("_own") == F.col("_gone")) & (F.col("_pos") == F.col("_at")) & (F.col("_number") >= F.col("_sequence")), "left_anti")
            by_columns: dict[tuple[int, ...], list[File]] = {}
            for d in equality:
                by_columns.setdefault(tuple(sorted(d.equality_ids)), []).append(d)
            for ids, group in by_columns.items():
                names = {f.metadata["parquet.field.id"]: f for f in self.schema}
                kind = T.StructType([names[i] for i in ids])
                gone = self._delete_rows(group, kind).select(*[F.col(f"`{f.name}`").alias(f"_d{f.metadata['parquet.field.id']}") for f in kind], "_number")
                same = [F.col(f"`{f.name}`").eqNullSafe(F.col(f"_d{f.metadata['parquet.field.id']}")) for f in kind]
                rows = rows.join(gone, [*same, F.col("_number") > F.col("_sequence")], "left_anti")
            rows = rows.drop("_own", "_sequence")
            parts.append(rows if keep_position else rows.drop("_file", "_pos"))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def _delete_rows(self, files: list[File], schema: T.StructType) -> DataFrame:
        """Rows of delete files, with each file's sequence number."""
        numbers = self.spark.createDataFrame([(_spelled(f.path), f.sequence) for f in files], "_path string, _number bigint")
        rows = self._read(schema, [f.path for f in files], True).withColumn("_own", F.regexp_replace("_file", "^file:/+", "/"))
        return rows.join(numbers, F.col("_own") == F.col("_path")).drop("_file", "_pos", "_own", "_path")

    def scan(self, columns: list[str] | None = None, where: list[Predicate] | None = None, snapshot_id: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
        """Rows of a snapshot with the columns of its own schema if one is named, else of the current one."""
        snapshot = self.snapshot(snapshot_id, as_of)
        named = snapshot_id is not None or as_of is not None
        schema = spark_type({"type": "struct", "fields": self._schema_json(snapshot if named else None)["fields"]})
        deletes = [f for f in self.all_files(snapshot) if f.content != DATA] if snapshot else []
        df = self._rows(self.plan_files(where, snapshot) if snapshot else [], deletes, schema)
        for predicate in where or []:
            df = df.where(condition(predicate))
        return df.select(*columns) if columns else df

    def count(self) -> int:
        """Rows; from metadata alone if nothing is deleted."""
        files = self.all_files(self.snapshot())
        return sum(f.rows for f in files) if all(f.content == DATA for f in files) else self.scan().count()

    # -- writing

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType) -> IcebergTable:
        store = Store(spark, path)
        if not store.create("metadata/v1.metadata.json", json.dumps(new_metadata(path, schema))):
            raise ValueError(f"table {path} exists")
        store.replace("metadata/version-hint.text", "1")
        return cls(spark, path)

    def _write_files(self, df: DataFrame, content: int, schema: T.StructType) -> list[dict]:
        """Parquet files of ``df`` with field ids, described as manifests hold them."""
        folder = f"data/{uuid.uuid4().hex}"
        ordered = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema])
        ordered.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        described = []
        kinds = {f["id"]: f["type"] for f in self._schema_json()["fields"] if isinstance(f["type"], str)} if content == DATA else {}
        back = self._read(schema, [f"{self.path}/{folder}"], True)
        # The set makes it a hash aggregate of objects: without one, bounds of strings would have Spark sort all rows by file.
        measures = [F.count("*").alias("rows"), F.collect_set(F.lit(1)).alias("_set"), F.first(F.col("_metadata.file_size")).alias("size")]
        for f in schema:
            number, c = f.metadata["parquet.field.id"], F.col(f"`{f.name}`")
            if number in kinds and kinds[number] not in ("binary", "float", "double"):
                measures += [F.min(c).alias(f"lo{number}"), F.max(c).alias(f"hi{number}")]
            measures.append(F.count_if(c.isNull()).alias(f"nu{number}"))
        for r in back.groupBy("_file").agg(*measures).collect():
            row = r.asDict()
            bounds = [[{"key": n, "value": b} for n, kind in kinds.items() if (b := _bound(kind, row.get(f"{x}{n}"))) is not None] for x in ("lo", "hi")]
            nulls = [{"key": f.metadata["parquet.field.id"], "value": row[f"nu{f.metadata['parquet.field.id']}"]} for f in schema]
            described.append({"content": content, "file_path": row["_file"], "file_format": "PARQUET", "partition": {}, "record_count": row["rows"], "file_size_in_bytes": row["size"], "null_value_counts": nulls, "lower_bounds": bounds[0], "upper_bounds": bounds[1], "equality_ids": None})
        return sorted(described, key=lambda f: f["file_path"])

    def append(self, df: DataFrame) -> int:
        files = self._write_files(df, DATA, self.schema)
        self._commit("append", files, [], False)
        return sum(f["record_count"] for f in files)

    def overwrite(self, df: DataFrame) -> int:
        """All rows are replaced; older snapshots keep theirs."""
        files = self._write_files(df, DATA, self.schema)
        self._commit("overwrite", files, [], True)
        return sum(f["record_count"] for f in files)

    def delete_where(self, where: Column) -> int:
        """Position deletes for the rows that satisfy ``where``."""
        files = self.all_files(self.snapshot())
        schema = T.StructType([T.StructField("file_path", T.StringType(), False, {"parquet.field.id": DELETE_PATH}), T.StructField("pos", T.LongType(), False, {"parquet.field.id": DELETE_POS})])
        rows = self._rows([f for f in files if f.content == DATA], [f for f in files if f.content != DATA], self.schema, keep_position=True).where(where)
        written = self._write_files(rows.select(F.col("_file").alias("file_path"), F.col("_pos").alias("pos")), POSITION_DELETES, schema)
        gone = sum(f["record_count"] for f in written)
        if gone:
            self._commit("delete", [], [f for f in written if f["record_count"]], False, self.meta.get("current-snapshot-id"))
        return gone

    def _commit(self, operation: str, data: list[dict], deletes: list[dict], replace: bool, rests_on: int | None = None, attempts: int = 20) -> None:
        """Publish the next version. An append fits any newer one; a change that rests on a snapshot only that one."""
        for _ in range(attempts):
            if rests_on is not None and self.meta.get("current-snapshot-id") != rests_on:
                raise CommitConflict("another writer changed the table")
            snapshot_id, sequence, now = uuid.uuid4().int >> 66, self.meta["last-sequence-number"] + 1, int(time.time() * 1000)
            kept = [] if replace else self.manifests(self.snapshot())
            added = [self._manifest(files, content, snapshot_id, sequence) for content, files in ((0, data), (1, deletes)) if files]
            name = f"metadata/snap-{snapshot_id}-{uuid.uuid4().hex}.avro"
            self.store.write_bytes(name, encode_file(MANIFEST_LIST, [{k: m.get(k) for k in _names(MANIFEST_LIST)} for m in kept + added]))
            current = self.meta.get("current-snapshot-id")
            summary = {"operation": operation, "added-data-files": str(len(data)), "added-records": str(sum(f["record_count"] for f in data))}
            snapshot = {"snapshot-id": snapshot_id, "sequence-number": sequence, "timestamp-ms": now, "manifest-list": f"{self.path}/{name}", "summary": summary, "schema-id": self.meta["current-schema-id"]}
            if current not in (None, -1):
                snapshot["parent-snapshot-id"] = current
            meta = self.meta | {"last-sequence-number": sequence, "last-updated-ms": now, "current-snapshot-id": snapshot_id, "snapshots": [*self.meta["snapshots"], snapshot]}
            meta["snapshot-log"] = [*self.meta.get("snapshot-log", []), {"snapshot-id": snapshot_id, "timestamp-ms": now}]
            meta["refs"] = {**self.meta.get("refs", {}), "main": {"snapshot-id": snapshot_id, "type": "branch"}}
            published = self.catalog.swap(self.state, meta, snapshot)
            self.refresh()
            if published:
                return
        raise CommitConflict(f"no commit in {attempts} attempts")

    def _manifest(self, files: list[dict], content: int, snapshot_id: int, sequence: int) -> dict:
        name = f"metadata/{uuid.uuid4().hex}-m0.avro"
        entries = [{"status": ADDED, "snapshot_id": snapshot_id, "sequence_number": None, "file_sequence_number": None, "data_file": f} for f in files]
        extra = {"schema": json.dumps(self._schema_json()), "partition-spec": "[]", "partition-spec-id": "0", "format-version": "2", "content": "deletes" if content else "data"}
        data = encode_file(MANIFEST, entries, extra)
        self.store.write_bytes(name, data)
        rows = sum(f["record_count"] for f in files)
        return {"manifest_path": f"{self.path}/{name}", "manifest_length": len(data), "partition_spec_id": 0, "content": content, "sequence_number": sequence, "min_sequence_number": sequence, "added_snapshot_id": snapshot_id, "added_files_count": len(files), "existing_files_count": 0, "deleted_files_count": 0, "added_rows_count": rows, "existing_rows_count": 0, "deleted_rows_count": 0}


def new_metadata(path: str, schema: T.StructType) -> dict:
    """The metadata of a new, empty, unpartitioned table."""
    fields = [{"id": k, "name": f.name, "required": not f.nullable, "type": format_type(f.dataType)} for k, f in enumerate(schema, 1)]
    now = int(time.time() * 1000)
    return {
        "format-version": 2, "table-uuid": str(uuid.uuid4()), "location": path.rstrip("/"), "last-sequence-number": 0, "last-updated-ms": now, "last-column-id": len(fields),
        "current-schema-id": 0, "schemas": [{"type": "struct", "schema-id": 0, "fields": fields}], "default-spec-id": 0, "partition-specs": [{"spec-id": 0, "fields": []}], "last-partition-id": 999,
        "default-sort-order-id": 0, "sort-orders": [{"order-id": 0, "fields": []}], "properties": {}, "current-snapshot-id": -1, "snapshots": [], "snapshot-log": [], "metadata-log": [], "refs": {},
    }


def _record(name: str, fields: list[tuple[str, int, object]]) -> dict:
    return {"type": "record", "name": name, "fields": [{"name": n, "field-id": i, "type": kind} | ({"default": None} if isinstance(kind, list) else {}) for n, i, kind in fields]}


def _map(name: str, key: int, value: int, kind: str) -> list:
    return ["null", {"type": "array", "logicalType": "map", "items": _record(name, [("key", key, "int"), ("value", value, kind)])}]


def _names(schema: dict) -> list[str]:
    return [f["name"] for f in schema["fields"]]


# The format's schemas of manifest lists and manifests, with their field ids.
MANIFEST_LIST = _record("manifest_file", [("manifest_path", 500, "string"), ("manifest_length", 501, "long"), ("partition_spec_id", 502, "int"), ("content", 517, "int"), ("sequence_number", 515, "long"), ("min_sequence_number", 516, "long"), ("added_snapshot_id", 503, "long"), ("added_files_count", 504, "int"), ("existing_files_count", 505, "int"), ("deleted_files_count", 506, "int"), ("added_rows_count", 512, "long"), ("existing_rows_count", 513, "long"), ("deleted_rows_count", 514, "long")])
DATA_FILE = _record("r2", [("content", 134, "int"), ("file_path", 100, "string"), ("file_format", 101, "string"), ("partition", 102, _record("r102", [])), ("record_count", 103, "long"), ("file_size_in_bytes", 104, "long"), ("null_value_counts", 110, _map("k121_v122", 121, 122, "long")), ("lower_bounds", 125, _map("k126_v127", 126, 127, "bytes")), ("upper_bounds", 128, _map("k129_v130", 129, 130, "bytes")), ("equality_ids", 135, ["null", {"type": "array", "items": "int"}])])
MANIFEST = _record("manifest_entry", [("status", 0, "int"), ("snapshot_id", 1, ["null", "long"]), ("sequence_number", 3, ["null", "long"]), ("file_sequence_number", 4, ["null", "long"]), ("data_file", 2, DATA_FILE)])
