"""Where intermediate tables of iterative operators go: the shared checkpoint folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder set on the context; only a local master may fall back to a folder of this machine."""
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext.getCheckpointDir():
        if not wanted and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="noticeflow-"))
    return wanted or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder: what comes after doesn't repeat what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_table(spark: SparkSession, name: str) -> str:
    """A folder for a table that doesn't exist yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
