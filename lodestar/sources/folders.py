"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or in a local session without it (tests) a temporary one; else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    now = spark.sparkContext.getCheckpointDir()
    if not (named or now):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        now = spark.sparkContext.getCheckpointDir()
    elif not now:
        spark.sparkContext.setCheckpointDir(named)
    return named or now


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as it is now, written to the shared folder: its lineage is cut, and a lost executor costs no more than its tasks."""
    shared_base(df.sparkSession)
    return df.checkpoint(eager=True)
