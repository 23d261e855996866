"""Folders and staged tables on storage that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir; only where that is unset and all runs in one process, a local temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-stream-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes `df` once and reads it back, where several jobs would compute it again."""
    path = folder(df.sparkSession, "staged")
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
