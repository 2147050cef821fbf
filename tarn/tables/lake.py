"""Lake tables over Parquet files and a log of immutable metadata versions.

``metadata/v<N>.json`` is the state of version N: schema with field ids, partition specs, snapshots. A snapshot names its
manifests, immutable lists of the files that one commit added, and which of their files are gone since, so a commit
writes what it adds and not what was there before. A commit publishes the next version under a name that must not exist yet; a writer that loses the race
rebases on the winner's version and checks for conflicts first. Data files store columns under their field ids, so
renames, drops and additions touch metadata only, and old files read with the current schema.

Row deletes are position deletes: (file, row index) files that a scan anti-joins. File pruning (partition values,
minima, maxima, null counts) happens in the driver before the reader is built; everything else is left to Catalyst.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.plans.materialize import materialize
from tarn.tables.files import Store
from tarn.tables.transforms import Transform

MAX_RETRIES = 100
DEFAULTS = {"format-version": "2", "write.parquet.compression-codec": "zstd", "write.target-file-size-bytes": str(512 << 20), "history.expire.max-snapshot-age-ms": str(5 * 86_400_000), "history.expire.min-snapshots-to-keep": "1", "write.isolation-level": "serializable", "maintenance.enabled": "true"}

#: Places of deleted rows that are broadcast, at most; rows that a task joins with places, about.
FEW, JOINED = 1 << 17, 1 << 19

#: (column, operator, value): =, <>, <, <=, >, >=, in, is null, is not null.
Predicate = tuple[str, str, object]


class CommitConflict(RuntimeError):
    """Another writer changed what this one had read."""


@dataclass
class State:
    version: int
    fields: list[dict]
    last_id: int
    specs: list[list[str]]
    snapshots: list[dict]
    properties: dict[str, str]
    uuid: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def current(self) -> dict:
        return self.snapshots[-1]


class Snapshot(dict):
    """A snapshot as it is written, whose ``files`` are read from its manifests when they are asked for."""

    def __init__(self, written: dict, table: LakeTable) -> None:
        super().__init__(written)
        self.table = table
        self.known: list[dict] | None = None

    def __getitem__(self, key: str) -> object:
        if key != "files":
            return super().__getitem__(key)
        if self.known is None:
            self.known = [f for m in self["manifests"] for k, f in enumerate(self.table._manifest(m["name"])) if k not in set(m["gone"])]
        return self.known


class LakeTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path)
        self._manifests: dict[str, list[dict]] = {}
        self.refresh()

    def _manifest(self, name: str) -> list[dict]:
        """The files of a manifest, which never changes."""
        if name not in self._manifests:
            self._manifests[name] = json.loads(self.store.read(f"metadata/{name}"))
        return self._manifests[name]

    def _new_manifest(self, files: list[dict]) -> list[dict]:
        """The entry of a new manifest, none for no files."""
        if not files:
            return []
        name = f"m-{uuid.uuid4().hex}.json"
        self.store.write_bytes(f"metadata/{name}", json.dumps(files).encode())
        self._manifests[name] = files
        return [{"name": name, "files": len(files), "rows": sum(f["rows"] for f in files), "gone": []}]

    def _without(self, manifests: list[dict], paths: set[str]) -> list[dict]:
        """Entries of manifests, with the files of ``paths`` marked as gone; those with no file left are dropped."""
        if not paths:
            return manifests
        out = []
        for m in manifests:
            gone = sorted({*m["gone"], *(k for k, f in enumerate(self._manifest(m["name"])) if f["path"] in paths)})
            if len(gone) < m["files"]:
                out.append(m | {"gone": gone})
        return out

    def _parsed(self, text: str) -> State:
        state = State(**json.loads(text))
        state.snapshots = [Snapshot(x, self) for x in state.snapshots]
        return state

    # -- life cycle

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, partition_by: list[str] | None = None, properties: dict[str, str] | None = None, if_not_exists: bool = False) -> LakeTable:
        store = Store(spark, path)
        if store.exists("metadata/v1.json"):
            if if_not_exists:
                return cls(spark, path)
            raise ValueError(f"table {path} exists")
        names = [f.name for f in schema]
        if len(set(names)) < len(names) or any(not n or len(n.encode()) > 63 or "\0" in n for n in names):
            raise ValueError("column names must be unique, not empty and shorter than 64 bytes")
        fields = [{"id": k, "name": f.name, "type": f.dataType.json(), "required": not f.nullable} for k, f in enumerate(schema, 1)]
        spec = [str(Transform.parse(p)) for p in partition_by or []]
        for part in map(Transform.parse, spec):
            if part.source not in names:
                raise ValueError(f"partition source {part.source} is no column")
        options = DEFAULTS | (properties or {})
        if unknown := set(options) - set(DEFAULTS):
            raise ValueError(f"unknown table options: {sorted(unknown)}")
        first = {"id": 0, "time": time.time(), "operation": "create", "manifests": [], "deletes": []}
        state = State(1, fields, len(fields), [spec], [first], options)
        if not store.create("metadata/v1.json", json.dumps(state.__dict__)):
            raise CommitConflict("another writer created the table")
        return cls(spark, path)

    @classmethod
    def create_as(cls, df: DataFrame, path: str, with_data: bool = True, **options) -> LakeTable:
        table = cls.create(df.sparkSession, path, df.schema, **options)
        if with_data:
            table.insert(df)
        return table

    def refresh(self) -> None:
        versions = [int(found[1]) for p, _, _ in self.store.list("metadata") if (found := re.search(r"/v(\d+)\.json$", p))]
        if not versions:
            raise ValueError(f"no table at {self.path}")
        self.state = self._parsed(self.store.read(f"metadata/v{max(versions)}.json"))

    def drop(self) -> None:
        self.store.delete("")

    # -- schema

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f["name"], T._parse_datatype_json_string(f["type"]), not f["required"]) for f in self.state.fields])

    def _alter(self, change: Callable[[State], None]) -> None:
        self._commit(lambda state: change(state), "schema", [], [], [])

    def _field(self, name: str, state: State | None = None) -> dict:
        for f in (state or self.state).fields:
            if f["name"] == name:
                return f
        raise ValueError(f"no column {name}")

    def add_column(self, name: str, kind: T.DataType) -> None:
        def change(state: State) -> None:
            if any(f["name"] == name for f in state.fields):
                raise ValueError(f"column {name} exists")
            state.last_id += 1
            state.fields.append({"id": state.last_id, "name": name, "type": kind.json(), "required": False})

        self._alter(change)

    def drop_column(self, name: str) -> None:
        def change(state: State) -> None:
            if any(Transform.parse(p).source == name for p in state.specs[-1]):
                raise ValueError(f"column {name} is a source of the current partition spec")
            state.fields.remove(self._field(name, state))

        self._alter(change)

    def rename_column(self, old: str, new: str) -> None:
        def change(state: State) -> None:
            if any(f["name"] == new for f in state.fields):
                raise ValueError(f"column {new} exists")
            self._field(old, state)["name"] = new
            state.specs = [[str(Transform(t.kind, new if t.source == old else t.source, t.width)) for t in map(Transform.parse, spec)] for spec in state.specs]

        self._alter(change)

    def drop_not_null(self, name: str) -> None:
        self._alter(lambda state: self._field(name, state).update(required=False))

    def replace_partition_spec(self, partition_by: list[str]) -> None:
        """New files follow the new spec; old files keep their own."""
        self._alter(lambda state: state.specs.append([str(Transform.parse(p)) for p in partition_by]))

    # -- reading

    def _snapshot(self, snapshot_id: int | None) -> dict:
        if snapshot_id is None:
            return self.state.current
        for s in self.state.snapshots:
            if s["id"] == snapshot_id:
                return s
        raise ValueError(f"no snapshot {snapshot_id}")

    def plan_files(self, where: list[Predicate] | None = None, snapshot_id: int | None = None) -> list[dict]:
        """The files that can hold rows satisfying all predicates."""
        return [f for f in self._snapshot(snapshot_id)["files"] if all(self._may_hold(f, p) for p in where or [])]

    def _may_hold(self, file: dict, predicate: Predicate) -> bool:
        column, op, value = predicate
        if op == "in":
            return any(self._may_hold(file, (column, "=", v)) for v in value)
        for text, stored in zip(self.state.specs[file["spec"]], file["partition"], strict=True):
            t = Transform.parse(text)
            if t.source == column and not t.may_match(stored, op, value):
                return False
        stats = file["stats"].get(str(self._field(column)["id"]))
        if stats is None:  # the file is older than the column: all NULL
            return op == "is null"
        low, high, nulls = stats
        if op == "is null":
            return nulls > 0
        if nulls == file["rows"]:
            return False
        kind = T._parse_datatype_json_string(self._field(column)["type"])
        temporal = isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType)
        if op == "is not null" or low is None or high is None or (temporal and not isinstance(value, dt.date)):
            return True
        if temporal and not isinstance(kind, T.DateType) and not isinstance(value, dt.datetime):
            value = dt.datetime.combine(value, dt.time())
        v = _comparable(value)
        if type(v) is not type(low) and not (isinstance(v, int | float) and isinstance(low, int | float)):
            return True
        return {"=": low <= v <= high, "<": low < v, "<=": low <= v, ">": high > v, ">=": high >= v, "<>": not (low == high == v and nulls == 0)}[op]

    def _read(self, files: list[dict], deletes: list[dict], keep_position: bool = False) -> DataFrame:
        fields = self.state.fields
        physical = T.StructType([T.StructField(f"c{f['id']}", T._parse_datatype_json_string(f["type"])) for f in fields])
        names = [F.col(f"c{f['id']}").alias(f["name"]) for f in fields]
        if not files:
            empty = self.spark.createDataFrame([], physical).select(*names)
            return empty.withColumns({"_file": F.lit(""), "_pos": F.lit(0).cast("bigint")}) if keep_position else empty
        touched = {f for d in deletes for f in d["targets"]}

        def scan(paths: list[str], with_position: bool) -> DataFrame:
            df = self.spark.read.schema(physical).parquet(*paths)
            return df.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos")) if with_position else df.select(*names)

        clean = [f["path"] for f in files if f["path"] not in touched]
        dirty = [f["path"] for f in files if f["path"] in touched]
        parts = [scan(clean, keep_position)] if clean else []
        if dirty:
            left = self._at(scan(dirty, True), [f for f in files if f["path"] in touched], [d for d in deletes if set(d["targets"]) & set(dirty)], "left_anti")
            parts.append(left if keep_position else left.drop("_file", "_pos"))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def _at(self, rows: DataFrame, files: list[dict], deletes: list[dict], how: str) -> DataFrame:
        """``rows`` of ``files`` at the places that ``deletes`` list (left_semi), or at others (left_anti).

        Files meet by their number in the table's own list, as their paths would make most of a row. How many places and
        rows there are is known: few places are broadcast, else tasks get about ``JOINED`` rows each. Sizes of files say
        nothing here, as places take next to no space there.
        """
        numbered = F.broadcast(self.spark.createDataFrame([(f["path"], k) for k, f in enumerate(files)], "_tarn_path string, _tarn_number int"))
        places = self.spark.read.schema("file string, pos bigint").parquet(*sorted({d["path"] for d in deletes}))
        gone = places.join(numbered, F.col("file") == F.col("_tarn_path")).select(F.col("_tarn_number").alias("_tarn_gone"), F.col("pos").alias("_tarn_at"))
        rows = rows.join(numbered, F.col("_file") == F.col("_tarn_path")).drop("_tarn_path")
        if sum(d["rows"] for d in deletes) <= FEW:
            gone = F.broadcast(gone)
        else:
            n = 1 + sum(f["rows"] for f in files) // JOINED
            rows, gone = rows.repartition(n, "_tarn_number", "_pos").hint("merge"), gone.repartition(n, "_tarn_gone", "_tarn_at")
        return rows.join(gone, (F.col("_tarn_number") == F.col("_tarn_gone")) & (F.col("_pos") == F.col("_tarn_at")), how).drop("_tarn_number")

    def scan(self, columns: list[str] | None = None, where: list[Predicate] | None = None, snapshot_id: int | None = None) -> DataFrame:
        """Rows of a snapshot: files pruned here, columns and residual filters pushed to the Parquet reader by Catalyst."""
        snapshot = self._snapshot(snapshot_id)
        df = self._read(self.plan_files(where, snapshot_id), snapshot["deletes"])
        for predicate in where or []:
            df = df.where(condition(predicate))
        return df.select(*columns) if columns else df

    def count(self, where: list[Predicate] | None = None) -> int:
        """Rows; from metadata alone if nothing is filtered and nothing deleted."""
        snapshot = self.state.current
        if not where and not snapshot["deletes"]:
            return sum(f["rows"] for f in snapshot["files"])
        return self.scan(where=where).count()

    def explain(self, where: list[Predicate]) -> str:
        kept, all_ = self.plan_files(where), self.state.current["files"]
        return f"files {len(kept)} of {len(all_)}, rows at most {sum(f['rows'] for f in kept)} of {sum(f['rows'] for f in all_)}; residual: {' AND '.join(f'{c} {o} {v}' for c, o, v in where)}"

    # -- writing

    def _write(self, df: DataFrame) -> list[dict]:
        """Data files of ``df`` under the current spec, with their statistics."""
        state, spec = self.state, [Transform.parse(p) for p in self.state.specs[-1]]
        for f in state.fields:
            if f["name"] not in df.columns and f["required"]:
                raise ValueError(f"column {f['name']} is required")
        kinds = {f["name"]: T._parse_datatype_json_string(f["type"]) for f in state.fields}
        values = [(F.col(f"`{f['name']}`") if f["name"] in df.columns else F.lit(None)).cast(kinds[f["name"]]).alias(f"c{f['id']}") for f in state.fields]
        keyed = df.select(*values, *[t.column(kinds[t.source].simpleString()).alias(f"p{k}") for k, t in enumerate(spec)])
        parts = [f"p{k}" for k in range(len(spec))]
        if parts:
            # Rows of a partition meet in as few files as AQE's target size allows, and a hot partition is split.
            keyed = keyed.hint("rebalance", *parts)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        writer = keyed.write.option("compression", state.properties["write.parquet.compression-codec"])
        (writer.partitionBy(*parts) if parts else writer).parquet(folder)
        return self._describe(folder, len(spec))

    def _describe(self, folder: str, n_parts: int) -> list[dict]:
        if not any(p.endswith(".parquet") for p, _, _ in self.store.list(folder.removeprefix(self.path + "/"))):
            return []
        state = self.state
        physical = T.StructType([T.StructField(f"c{f['id']}", T._parse_datatype_json_string(f["type"])) for f in state.fields] + [T.StructField(f"p{k}", T.StringType()) for k in range(n_parts)])
        df = self.spark.read.schema(physical).option("basePath", folder).parquet(folder)
        # The set makes it a hash aggregate of objects: without one, bounds of strings would have Spark sort all rows by file.
        measures = [F.count("*").alias("rows"), F.collect_set(F.lit(1)).alias("_set"), F.first(F.col("_metadata.file_size")).alias("size"), *[F.first(f"p{k}").alias(f"p{k}") for k in range(n_parts)]]
        for f in state.fields:
            c, kind = F.col(f"c{f['id']}"), T._parse_datatype_json_string(f["type"])
            ordered = isinstance(kind, T.NumericType | T.StringType | T.DateType | T.TimestampType | T.TimestampNTZType | T.BooleanType)
            measures += [(F.min(c) if ordered else F.lit(None)).alias(f"lo{f['id']}"), (F.max(c) if ordered else F.lit(None)).alias(f"hi{f['id']}"), F.count_if(c.isNull()).alias(f"nu{f['id']}")]
        out = []
        for r in df.groupBy(F.col("_metadata.file_path").alias("path")).agg(*measures).collect():
            stats = {str(f["id"]): [_comparable(r[f"lo{f['id']}"]), _comparable(r[f"hi{f['id']}"]), r[f"nu{f['id']}"]] for f in state.fields}
            for f in state.fields:
                if f["required"] and r[f"nu{f['id']}"]:
                    raise ValueError(f"NULL in required column {f['name']}")
            out.append({"path": r["path"], "rows": r["rows"], "size": r["size"], "spec": len(state.specs) - 1, "partition": [r[f"p{k}"] for k in range(n_parts)], "stats": stats})
        return sorted(out, key=lambda f: f["path"])

    def _write_deletes(self, positions: DataFrame) -> list[dict]:
        if self.state.properties["format-version"] == "1":
            raise ValueError("format version 1 cannot delete rows")
        folder = f"{self.path}/data/{uuid.uuid4().hex}-deletes"
        positions.select(F.col("_file").alias("file"), F.col("_pos").alias("pos")).write.parquet(folder)
        targets = [r[0] for r in self.spark.read.parquet(folder).select("file").distinct().collect()]
        rows = self.spark.read.parquet(folder).count()
        return [{"path": folder, "targets": targets, "rows": rows}] if targets else []

    def _commit(self, change: Callable[[State], None] | None, operation: str, add: list[dict], deletes: list[dict], remove: list[str], read: list[list[Predicate]] | None = None, base: dict | None = None) -> None:
        """Publish the next version; on a lost race rebase on the winner's, unless it changed what this one has read.

        ``read``: the conditions, each a list of predicates (an empty one reads every row), whose rows the change rests
        on. ``base``: the snapshot that it has seen, if not the handle's current one.
        """
        base = base or self.state.current
        base_files, base_deletes = {f["path"] for f in base["files"]}, {d["path"] for d in base["deletes"]}
        touched = {t for d in deletes for t in d["targets"]} | set(remove)
        added = self._new_manifest(add)  # whatever version it will belong to
        for _ in range(MAX_RETRIES):
            state = self._parsed(json.dumps(self.state.__dict__))
            now = state.current
            if now["id"] != base["id"]:
                files = {f["path"] for f in now["files"]}
                if touched - files:
                    raise CommitConflict("a file with changed rows was replaced by another writer")
                if any(set(d["targets"]) & touched for d in now["deletes"] if d["path"] not in base_deletes):
                    raise CommitConflict("another writer changed rows of the same file")
                if read and state.properties["write.isolation-level"] == "serializable":
                    for f in now["files"]:
                        if f["path"] not in base_files and any(all(self._may_hold(f, p) for p in each) for each in read):
                            raise CommitConflict("another writer added rows that the condition may match")
            if change:
                change(state)
            if operation != "schema":
                kept = [d for d in now["deletes"] if set(d["targets"]) - set(remove)]
                manifests = self._without(now["manifests"], set(remove)) + added
                state.snapshots.append(Snapshot({"id": now["id"] + 1, "time": time.time(), "operation": operation, "manifests": manifests, "deletes": kept + deletes}, self))
            state.version += 1
            if self.store.create(f"metadata/v{state.version}.json", json.dumps(state.__dict__)):
                self.state = state
                return
            self.refresh()
        raise CommitConflict(f"no commit in {MAX_RETRIES} attempts")

    def insert(self, df: DataFrame) -> int:
        files = self._write(df)
        self._commit(None, "append", files, [], [])
        return sum(f["rows"] for f in files)

    def insert_returning(self, df: DataFrame) -> DataFrame:
        """INSERT … RETURNING: the stored rows, read back from the new files."""
        files = self._write(df)
        self._commit(None, "append", files, [], [])
        return self._read(files, [])

    def delete_returning(self, where: Column | list[Predicate]) -> DataFrame:
        """DELETE … RETURNING: the rows as they were."""
        rows, read = self._matching(where)
        deletes = self._write_deletes(rows)
        gone = self._rows_at(deletes) if deletes else rows.drop("_file", "_pos").limit(0)
        self._commit(None, "delete", [], deletes, [], [read])
        return gone

    def _matching(self, where: Column | list[Predicate]) -> tuple[DataFrame, list[Predicate]]:
        """The rows that satisfy ``where``, with their places, and what of it is known about files (a column: nothing)."""
        predicates = where if isinstance(where, list) else []
        df = self._read(self.plan_files(predicates), self.state.current["deletes"], keep_position=True)
        for p in predicates:
            df = df.where(condition(p))
        return (df if isinstance(where, list) else df.where(where)), predicates

    def delete(self, where: Column | list[Predicate]) -> int:
        rows, read = self._matching(where)
        deletes = self._write_deletes(rows)
        self._commit(None, "delete", [], deletes, [], [read])
        return sum(d["rows"] for d in deletes)

    def update(self, where: Column | list[Predicate], values: dict[str, Column]) -> int:
        """Position deletes for the old rows, new files for the new ones, in one commit."""
        rows, read = self._matching(where)
        deletes = self._write_deletes(rows)
        if not deletes:
            return 0
        changed = self._rows_at(deletes)
        files = self._write(changed.withColumns({c: F.expr(v) if isinstance(v, str) else v for c, v in values.items()}))
        self._commit(None, "overwrite", files, deletes, [], [read])
        return deletes[0]["rows"]

    def _rows_at(self, deletes: list[dict], files: list[dict] | None = None) -> DataFrame:
        targets = {t for d in deletes for t in d["targets"]}
        files = [f for f in (self.state.current["files"] if files is None else files) if f["path"] in targets]
        return self._at(self._read(files, [], keep_position=True), files, deletes, "left_semi").drop("_file", "_pos")

    def merge(self, source: DataFrame, on: list[str], update: dict[str, str] | None = None, delete_when: str | None = None, insert: bool = True) -> dict[str, int]:
        """MERGE by equal keys: ``update`` sets target columns to expressions over t.* and s.*; ``delete_when`` comes first.

        A target row that two source rows match is an error. The source is evaluated once; files whose key ranges the
        source cannot meet are not read.
        """
        files, deletes, read = self._merge(source, on, update, delete_when, insert, self.state.current)
        self._commit(None, "overwrite", files, deletes, [], [read])
        return {"deleted": sum(d["rows"] for d in deletes), "written": sum(f["rows"] for f in files)}

    def _merge(self, source: DataFrame, on: list[str], update: dict[str, str] | None, delete_when: str | None, insert: bool, seen: dict) -> tuple[list[dict], list[dict], list[Predicate]]:
        """(new files, new deletes, what was read) of a MERGE into the files and deletes of ``seen``."""
        source = materialize(source, "merge-source")
        bounds = source.agg(*[f(F.col(f"`{k}`")).alias(f"{f.__name__}{i}") for i, k in enumerate(on) for f in (F.min, F.max)]).first()
        read: list[Predicate] = [(k, op, bounds[f"{name}{i}"]) for i, k in enumerate(on) for op, name in ((">=", "min"), ("<=", "max")) if bounds[f"{name}{i}"] is not None]
        near = [f for f in seen["files"] if all(self._may_hold(f, p) for p in read)]
        t, s = self._read(near, seen["deletes"], keep_position=True).alias("t"), source.alias("s")
        keys = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on]
        goes = F.coalesce(F.expr(delete_when), F.lit(False)) if delete_when else F.lit(False)
        values = [(F.expr(update[c]) if c in update else F.col(f"t.`{c}`")).alias(c) for c in self.schema.names] if update is not None else []
        # Written once: deletes and new rows come from the same match.
        matched = materialize(t.join(s, keys, "inner").select(F.col("t._file").alias("_file"), F.col("t._pos").alias("_pos"), goes.alias("_goes"), F.struct(F.lit(1).alias("_one"), *values).alias("_new")), "merge")
        if not matched.groupBy("_file", "_pos").count().where("count > 1").isEmpty():
            raise ValueError("MERGE command cannot affect row a second time")
        deletes = self._write_deletes((matched.where("_goes") if update is None else matched).select("_file", "_pos"))
        new = []
        if update is not None:
            new.append(matched.where("NOT _goes").select("_new.*").drop("_one"))
        if insert:
            new.append(s.join(t, keys, "left_anti").select(*[F.col(f"`{c}`") for c in source.columns]))
        return [f for df in new for f in self._write(df)], deletes, read

    def truncate(self) -> None:
        self._commit(None, "delete", [], [], [f["path"] for f in self.state.current["files"]], [[]])

    def transaction(self) -> Transaction:
        return Transaction(self)

    # -- maintenance and introspection

    def compact(self, min_inputs: int = 5, low: float = 0.75, high: float = 1.8, delete_ratio: float = 0.3) -> dict[str, int]:
        """Rewrite files far from the target size or with many deleted rows, in groups of one partition."""
        target = int(self.state.properties["write.target-file-size-bytes"])
        snapshot = self.state.current
        gone: dict[str, int] = {}
        for d in snapshot["deletes"]:
            for t in d["targets"]:
                gone[t] = gone.get(t, 0) + d["rows"]
        chosen = [f for f in snapshot["files"] if f["size"] < low * target or f["size"] > high * target or gone.get(f["path"], 0) >= delete_ratio * f["rows"]]
        groups: dict[str, list[dict]] = {}
        for f in chosen:
            groups.setdefault(json.dumps([f["spec"], f["partition"]]), []).append(f)
        picked = [f for g in groups.values() if len(g) >= min_inputs or any(gone.get(f["path"], 0) >= delete_ratio * f["rows"] for f in g) for f in g]
        report = {"scanned": len(snapshot["files"]), "eligible": len(chosen), "selected": len(picked), "rows": 0}
        if picked:
            n = max(1, -(-sum(f["size"] for f in picked) // target))
            files = self._write(self._read(picked, snapshot["deletes"]).coalesce(n))
            report["rows"] = sum(f["rows"] for f in files)
            self._commit(None, "replace", files, [], [f["path"] for f in picked], None)
        return report

    def expire_snapshots(self, older_than_ms: int | None = None, keep: int | None = None) -> int:
        age = int(self.state.properties["history.expire.max-snapshot-age-ms"]) if older_than_ms is None else older_than_ms
        least = int(self.state.properties["history.expire.min-snapshots-to-keep"]) if keep is None else keep
        before = len(self.state.snapshots)

        def change(state: State) -> None:
            bound = time.time() - age / 1000
            state.snapshots = [s for k, s in enumerate(state.snapshots) if s["time"] >= bound or k >= len(state.snapshots) - max(1, least)]

        self._commit(change, "schema", [], [], [])
        return before - len(self.state.snapshots)

    def _live(self) -> tuple[set[str], set[str]]:
        """(data files, folders of delete files) that some snapshot of the newest version lists."""
        self.refresh()
        return {_plain(f["path"]) for s in self.state.snapshots for f in s["files"]}, {_plain(d["path"]) for s in self.state.snapshots for d in s["deletes"]}

    def remove_orphans(self, older_than_ms: int = 3 * 86_400_000) -> int:
        """Delete data files that no snapshot lists; at least a day old, so that running writers keep theirs.

        The newest version counts, whatever this handle has seen. It is read again after the files are listed, so a
        commit in between keeps what it published.
        """
        if older_than_ms < 86_400_000:
            raise ValueError("orphans must be at least one day old")
        bound, n = time.time() * 1000 - older_than_ms, 0
        found = [_plain(path) for path, _, modified in self.store.list("data") if modified < bound]
        lists = self.store.list("metadata")
        live, folders = self._live()
        for own in found:
            if own not in live and own.rsplit("/", 1)[0] not in folders:
                self.store.delete(own.removeprefix(_plain(self.path) + "/"))
                n += 1
        named = {m["name"] for s in self.state.snapshots for m in s["manifests"]}
        for path, _, modified in lists:
            name = path.rsplit("/", 1)[1]
            if modified < bound and name.startswith("m-") and name not in named:
                self.store.delete(f"metadata/{name}")
        return n

    def files(self, snapshot_id: int | None = None) -> DataFrame:
        rows = [(f["path"], f["rows"], f["size"], f["spec"], [str(p) for p in f["partition"]]) for f in self._snapshot(snapshot_id)["files"]]
        return self.spark.createDataFrame(rows, "path string, record_count bigint, size_bytes bigint, spec_id int, partition array<string>")

    def snapshots(self) -> DataFrame:
        rows = [(s["id"], s["time"], s["operation"], sum(m["files"] - len(m["gone"]) for m in s["manifests"])) for s in self.state.snapshots]
        return self.spark.createDataFrame(rows, "snapshot_id bigint, committed double, operation string, files int")

    def partition_spec(self) -> DataFrame:
        rows = [(k, str(t), t.source) for k, t in enumerate(map(Transform.parse, self.state.specs[-1]))]
        return self.spark.createDataFrame(rows, "position int, transform string, source string")


class Transaction:
    """Several changes of one writer, visible to its own reads, published by one commit.

    What it has read (the conditions of its scans, deletes, updates and merges) is checked against what others have
    committed since it began, at the table's isolation level.
    """

    def __init__(self, table: LakeTable) -> None:
        self.table, self.add, self.deletes = table, [], []
        self.read: list[list[Predicate]] = []

    def __enter__(self) -> Transaction:
        self.table.refresh()
        self.base = self.table.state.current
        return self

    def _overlay(self) -> dict:
        return {"files": self.base["files"] + self.add, "deletes": self.base["deletes"] + self.deletes}

    def _rows(self, where: Column | list[Predicate] | None, keep_position: bool = False) -> DataFrame:
        seen, predicates = self._overlay(), where if isinstance(where, list) else []
        self.read.append(predicates)
        df = self.table._read([f for f in seen["files"] if all(self.table._may_hold(f, p) for p in predicates)], seen["deletes"], keep_position)
        for p in predicates:
            df = df.where(condition(p))
        return df.where(where) if isinstance(where, Column) else df

    def insert(self, df: DataFrame) -> None:
        self.add += self.table._write(df)

    def scan(self, where: Column | list[Predicate] | None = None) -> DataFrame:
        return self._rows(where)

    def delete(self, where: Column | list[Predicate]) -> None:
        self.deletes += self.table._write_deletes(self._rows(where, keep_position=True))

    def update(self, where: Column | list[Predicate], values: dict[str, Column]) -> None:
        seen = self._overlay()
        deletes = self.table._write_deletes(self._rows(where, keep_position=True))
        if deletes:
            changed = self.table._rows_at(deletes, seen["files"])
            self.add += self.table._write(changed.withColumns({c: F.expr(v) if isinstance(v, str) else v for c, v in values.items()}))
            self.deletes += deletes

    def merge(self, source: DataFrame, on: list[str], update: dict[str, str] | None = None, delete_when: str | None = None, insert: bool = True) -> None:
        files, deletes, read = self.table._merge(source, on, update, delete_when, insert, self._overlay())
        self.add, self.deletes = self.add + files, self.deletes + deletes
        self.read.append(read)

    def savepoint(self) -> tuple[int, int]:
        return len(self.add), len(self.deletes)

    def rollback_to(self, mark: tuple[int, int]) -> None:
        del self.add[mark[0] :], self.deletes[mark[1] :]

    def __exit__(self, kind, value, trace) -> None:
        if kind is not None or not (self.add or self.deletes):
            return
        add, deletes = self.add, self.deletes
        own = {f["path"] for f in add}
        if any(set(d["targets"]) & own for d in deletes):
            # Own rows that were changed again are rewritten away, so published deletes point at older files only.
            add = self.table._write(self.table._read(add, deletes))
            deletes = [d for d in (d | {"targets": [t for t in d["targets"] if t not in own]} for d in deletes) if d["targets"]]
        self.table._commit(None, "overwrite", add, deletes, [], self.read, self.base)


def _plain(path: str) -> str:
    """A path without the spellings of the local scheme."""
    return path.replace("file:///", "/").replace("file:/", "/")


def _comparable(value: object) -> object:
    """A value as JSON can hold and compare it."""
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else None
    if isinstance(value, float) and value != value:
        return None
    return value if isinstance(value, str | int | float | bool) or value is None else None


def condition(predicate: Predicate) -> Column:
    column, op, value = predicate
    c = F.col(f"`{column}`")
    if op == "in":
        return c.isin(*value)
    if op in ("is null", "is not null"):
        return c.isNull() if op == "is null" else c.isNotNull()
    return {"=": c == value, "<>": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]
