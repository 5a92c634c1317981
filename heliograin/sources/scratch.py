"""Folders for what a query writes and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is sent to all tasks of a join instead of shuffling the other side.
FEW = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one under /tmp only where none is named and all runs on this machine (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, lineage cut, readable after an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def beside(df: DataFrame) -> DataFrame:
    """The rows, computed once; sent whole to the tasks of a join if they are few."""
    held = cut(df)
    return F.broadcast(held) if held.limit(FEW + 1).count() <= FEW else held
