"""Tables that are written once and read by many steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only in local mode, where that is
    unset, a temporary folder stands in for it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tempolin-"))
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path that nothing has been written to, in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(table: DataFrame) -> DataFrame:
    """``table``, written to the shared folder: plans that read it often stay short, and it outlives any executor."""
    shared_folder(table.sparkSession)
    return table.checkpoint()
