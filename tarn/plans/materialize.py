"""Cutting lineage with written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: (session, path, scope) of each written table.
_written: list[tuple[SparkSession, str, str]] = []
_scopes: list[str] = [""]
#: Shuffle files go as soon as the table that needed them is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables written inside belong to ``name``, so that they can be released together."""
    _scopes.append(name)
    try:
        yield
    finally:
        _scopes.pop()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master one is set where none is (tests).

    On a cluster a folder of one machine would lose data, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tarn-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files when they end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str = "table", bucket_by: tuple[str, int] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the written table.

    The lineage ends at files that outlive any executor, so a lost executor costs a re-read and never a
    recomputation, and values that depend on task ids or arrival order are fixed once written. The shuffles behind the
    table are deleted with the write. ``bucket_by`` (column, number) writes one file for each bucket: grouping or
    joining by the column then reads the table without another shuffle.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarn-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path, _scopes[-1]))
    with _shuffles_removed(spark):
        if bucket_by is None:
            df.write.option("compression", "zstd").parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        column, n = bucket_by
        known = "tarn_" + uuid.uuid4().hex
        df.repartition(n, column).write.bucketBy(n, column).option("path", path).option("compression", "zstd").saveAsTable(known)
    table = spark.table(known).select("*")
    spark.sql(f"DROP TABLE {known}")  # the catalog's entry; the files stay
    return table


def release(spark: SparkSession, scope_name: str | None = None) -> int:
    """Delete the tables this session has written (of one scope, if named); returns how many."""
    mine = [entry for entry in _written if entry[0] is spark and scope_name in (None, entry[2])]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for entry in mine:
        path = jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(conf).delete(path, True)
        _written.remove(entry)
    return len(mine)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _, _ in _written}.values():
        try:
            release(spark)
        except Exception:  # the session has ended before the interpreter
            continue
