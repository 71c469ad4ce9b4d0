"""Tables written to the folder that all executors share, and read back.

Staging cuts the lineage (a lost executor rereads files instead of repeating the
work) and gives the planner the sizes of the files. A file's size says little of its
rows in memory, and less after an explode, so joins of tables that grow with the
input ask for a shuffle (``dealt``).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where the master is local (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can read")
        configured = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that deals both sides by key, whatever size the planner takes them for: neither goes through the driver whole."""
    return df.hint("merge")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table of its own in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
