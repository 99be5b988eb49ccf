"""Session defaults and the two helpers that depend on session settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "crowdpanel", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on.

    UTC session time zone (dates are never shifted), adaptive execution (it picks
    broadcast joins from measured sizes, coalesces small partitions and splits
    skewed ones). Shuffle partitions are left to the cluster unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """An unused path in the folder that the driver and all executors share."""
    return f"{_shared_folder(spark)}/crowdpanel/{uuid.uuid4().hex}"


def durable_table(df: DataFrame) -> DataFrame:
    """Write a frame with several consumers as Parquet in the shared folder and read it back.

    Cuts lineage, survives lost executors, and unlike a checkpointed RDD keeps
    column pruning, pushed filters and size statistics for the planner.
    """
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
