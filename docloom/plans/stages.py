"""Cutting a plan between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one that the cluster names in spark.checkpoint.dir. Where none is named, a local session gets a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir", "")
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="docloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that what follows is planned anew and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
