"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table up to which it may be sent whole to all tasks, through the driver's memory.
BROADCAST_BYTES = 4 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, a local session takes a temporary folder; a cluster raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            base = set_dir.get()
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="terraloom-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/terraloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: a short lineage that survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joinable(df: DataFrame, rows: int | None = None, row_bytes: int = 200) -> DataFrame:
    """df as the side of a join: sent whole if its rows are known to be few, else dealt out.

    Left to itself, Spark goes by the size of files, of which packed ones grow many times in the driver's memory.
    """
    return F.broadcast(df) if rows is not None and rows * row_bytes <= BROADCAST_BYTES else df.hint("merge")
