"""Cutting lineage inside iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, else ``spark.checkpoint.dir``; only a local session may fall back to /tmp."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared:
            sc.setCheckpointDir(shared)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="gatelens-checkpoint-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and read it back.

    The table survives the loss of executors, ends the lineage, and gives the planner true sizes, so that a join in
    the next round broadcasts a side only when it is small.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
