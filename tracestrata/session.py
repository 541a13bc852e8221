"""Session defaults, and the shared folder for lineage cuts and scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tracestrata.errors import ContractError

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str = "tracestrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this package's defaults; `conf` keys use '__' for '.'."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = _DEFAULTS | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Dates, ages and day partitions are all defined in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a local one only if it names none."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ContractError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"tracestrata-{uuid.uuid4().hex}")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; survives the loss of executors.

    Used where a small aggregate feeds several branches, so that the large
    input below it is scanned and shuffled a single time.
    """
    _shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unique folder below the shared checkpoint folder."""
    return f"{_shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
