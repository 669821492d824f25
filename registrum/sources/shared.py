"""Lineage cuts through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from the session. Only a local session without one gets its own, for as long as
    this process lives; on a cluster it must be set."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            held = tempfile.mkdtemp(prefix="registrum-checkpoints-")
            atexit.register(shutil.rmtree, held, ignore_errors=True)
            folder = f"file://{held}"
        context.setCheckpointDir(folder)
    return folder or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(True)


def kept(df: DataFrame) -> DataFrame:
    """The same as a compressed table by columns: several times smaller than a checkpoint, and only what is asked for is read."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/kept/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
