"""What the operators of this subpackage share: tables in the cluster's shared folder, id bitmaps, connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; only where that is unset and all runs in one process (tests), a temporary one that goes at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes `df` as a Parquet table into the shared folder and reads it back: lineage ends there, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by `stored` that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def bitmap(ids: DataFrame, column: str, bits: int = 1 << 24, hashed: bool = False) -> np.ndarray:
    """A bit for each class of a long column (its xxhash64, or, if `hashed`, itself, modulo `bits`): a filter of fixed size without false negatives, made by SQL.

    Bits are packed, eight in a byte; `has` looks them up.
    """
    at = f"pmod({column if hashed else f'xxhash64({column})'}, {bits})"
    words = (
        ids.select(F.expr(f"shiftright({at}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({at} % 64 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bit"].to_numpy()
    return out.view(np.uint8)


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places `at` are set in a bitmap."""
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected `links` (a, b): label is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each is a minimum by node with map-side
    combining and a join, so a hub of any degree is neither collected nor squared. The links are written to the shared
    folder after each round; the driver sees two numbers a round.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", "m")).distinct()
        fresh = stored(small, "links")
        now = fresh.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        forget(edges)
        edges = fresh
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
