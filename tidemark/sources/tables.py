"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or that the session has been given for checkpoints.

    Where there is none, one of our own serves if the whole session is on this machine; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not named and not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder, and one of this machine isn't shared by the executors")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return named or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process; local-cluster starts processes of its own."""
    return master == "local" or master.startswith("local[")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: later steps read it, and a lost executor costs no repetition."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
