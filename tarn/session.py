"""Session builder with the settings that the engine relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.files.openCostInBytes": "4m",
}


def get_session(app: str = "tarn", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` keys use ``__`` for dots.

    Give ``master`` in tests only; on a cluster the submitter sets it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        scratch = os.environ.get("TARN_SCRATCH", tempfile.gettempdir())
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", f"{scratch}/tarn-warehouse")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
