"""A directory of lake tables: namespaces, introspection and import of schemas."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.tables.files import Store
from tarn.tables.lake import CommitConflict, LakeTable

_NAME = re.compile(r"[^/\0]{1,63}\Z")


class LakeCatalog:
    """Tables at ``root/namespace/name``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)

    def _path(self, namespace: str, name: str) -> str:
        for part in (namespace, name):
            if not _NAME.match(part):
                raise ValueError(f"no name: {part!r}")
        return f"{self.root}/{namespace}/{name}"

    def create(self, namespace: str, name: str, schema: T.StructType, **options) -> LakeTable:
        return LakeTable.create(self.spark, self._path(namespace, name), schema, **options)

    def load(self, namespace: str, name: str) -> LakeTable:
        return LakeTable(self.spark, self._path(namespace, name))

    def drop(self, namespace: str, name: str) -> None:
        self.load(namespace, name).drop()

    def names(self, namespace: str | None = None) -> list[tuple[str, str]]:
        found = {tuple(m.groups()) for p, _, _ in self.store.list("") if (m := re.search(r"/([^/]+)/([^/]+)/metadata/v1\.json$", p))}
        return sorted(x for x in found if namespace in (None, x[0]))

    def tables(self) -> DataFrame:
        """namespace, name, version, snapshot_id, files, record_count, size_bytes of every table."""
        rows = []
        for namespace, name in self.names():
            t = self.load(namespace, name)
            files = t.state.current["files"]
            rows.append((namespace, name, t.state.version, t.state.current["id"], len(files), sum(f["rows"] for f in files), sum(f["size"] for f in files)))
        return self.spark.createDataFrame(rows, "namespace string, name string, version bigint, snapshot_id bigint, files int, record_count bigint, size_bytes bigint")

    def import_schema(self, namespace: str, only: list[str] | None = None, but: list[str] | None = None, strict: bool = False) -> dict[str, LakeTable]:
        """Register a namespace's tables as temporary views; tables without a readable column are skipped, or an error if strict."""
        out = {}
        for _, name in self.names(namespace):
            if (only is not None and name not in only) or name in (but or []):
                continue
            table = self.load(namespace, name)
            readable = [f.name for f in table.schema if not isinstance(f.dataType, T.NullType)]
            if len(readable) < len(table.schema) and strict:
                raise ValueError(f"table {name} has columns of no readable type")
            if readable:
                table.scan(readable).createOrReplaceTempView(name)
                out[name] = table
        if only and (missing := set(only) - set(out)):
            raise ValueError(f"no tables {sorted(missing)} in {namespace}")
        return out


@dataclass(frozen=True)
class Policy:
    """What ``maintain`` does to a table, and when.

    ``min_inputs``: files of a partition far from the target size before they are compacted. ``expire_ms``: age of
    snapshots that go, with ``keep`` of the newest always kept. ``orphans_ms``: age of unlisted files that go; None for
    no such step. A table with the property ``maintenance.enabled`` = false is left alone.
    """

    min_inputs: int = 5
    expire_ms: int = 5 * 86_400_000
    keep: int = 1
    orphans_ms: int | None = 3 * 86_400_000


def maintain(catalog: LakeCatalog, policy: Policy = Policy(), namespace: str | None = None) -> DataFrame:
    """Compaction, expiry of snapshots and removal of orphans on every table of a catalog; one row of report for each.

    A step that loses to another writer is reported and left to the next call; the other tables go on.
    """
    rows = []
    for own, name in catalog.names(namespace):
        table = catalog.load(own, name)
        report: dict[str, int | None] = {"compacted": None, "expired": None, "removed": None}
        problem = None
        if table.state.properties.get("maintenance.enabled", "true") != "false":
            steps = {"compacted": lambda t=table: t.compact(policy.min_inputs)["selected"], "expired": lambda t=table: t.expire_snapshots(policy.expire_ms, policy.keep)}
            if policy.orphans_ms is not None:
                steps["removed"] = lambda t=table: t.remove_orphans(policy.orphans_ms)
            for step, run in steps.items():
                try:
                    report[step] = run()
                except CommitConflict as lost:
                    problem = f"{step}: {lost}"
                    table.refresh()
        rows.append((own, name, *report.values(), problem))
    return catalog.spark.createDataFrame(rows, "namespace string, name string, compacted bigint, expired bigint, removed bigint, problem string")


def column_statistics(rows: DataFrame) -> DataFrame:
    """One row for each column: null share, distinct values (about), bounds as text. One pass over ``rows``."""
    measures = []
    for k, name in enumerate(rows.columns):
        c = F.col(f"`{name}`")
        ordered = not isinstance(rows.schema[name].dataType, T.MapType | T.VariantType)
        measures += [F.avg(c.isNull().cast("double")).alias(f"n{k}"), (F.approx_count_distinct(c) if ordered else F.lit(None).cast("bigint")).alias(f"d{k}")]
        measures += [(f(c) if ordered else F.lit(None)).cast("string").alias(f"{x}{k}") for x, f in (("l", F.min), ("h", F.max))]
    one = rows.agg(*measures)
    entries = [F.struct(F.lit(name).alias("column"), F.col(f"n{k}").alias("null_share"), F.col(f"d{k}").alias("distinct_values"), F.col(f"l{k}").alias("low"), F.col(f"h{k}").alias("high")) for k, name in enumerate(rows.columns)]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def analyze(table: LakeTable, sample_files: int = 32, fraction: float = 0.1, seed: int = 1) -> DataFrame:
    """Column statistics from a sample of at most ``sample_files`` files, the same for the same table and seed."""
    files = sorted(table.state.current["files"], key=lambda f: zlib.crc32(f"{seed}/{f['path']}".encode()))[:sample_files]
    rows = table._read(files, table.state.current["deletes"])
    return column_statistics(rows.sample(fraction, seed) if fraction < 1 else rows)
