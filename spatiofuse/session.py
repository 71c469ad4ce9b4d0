"""Session helpers: local builder for tests and lineage cuts that respect the cluster's settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spatiofuse")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # spatial joins expand few small rows into much work: keep small partitions apart
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory that checkpoints go to: the session's own setting first.

    A temporary folder is used only for a local master (tests); on a cluster an
    unset ``spark.checkpoint.dir`` is an error, because executors could not read
    a driver-local path.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if context.master.split("[")[0] != "local":  # executors of a local cluster need not share a folder
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        configured = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a parquet table in the shared checkpoint folder and continue from the files.

    A lost executor rereads files instead of repeating the work, later steps read
    only the columns they need, and the planner knows the exact size.
    """
    path = new_path(df.sparkSession, "cut")
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
