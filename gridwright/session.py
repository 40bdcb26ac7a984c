"""Session defaults. All temporal expressions assume the session zone is UTC."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
}

STATIC_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the Python line of every expression costs more than building the plan itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def build_session(
    app: str = "gridwright", master: str | None = None, **conf: object
) -> SparkSession:
    """Create (or reuse) a session carrying the engine settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**STATIC_SETTINGS, **SETTINGS, **conf}.items():
        builder = builder.config(key, str(value))
    return use_engine_settings(builder.getOrCreate())


def use_engine_settings(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@lru_cache(maxsize=8)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``).

    Only a session whose executors are threads of the driver may leave that setting out; one
    temporary folder then takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/gridwright-{label}-{uuid.uuid4().hex}"


def materialize(df, label: str):
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives
    lost executors and pins non-deterministic ids."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
