"""Tables that change all at once: data files are written beside the old ones, and a small manifest, created by one rename, says which count.

A manifest maps each partition folder (or the whole table) to the data folder that holds its newest version. Writers that fail leave
files that no manifest names; two writers from one state cannot both commit. Partitions not written keep their version, so a write replaces
only what it holds. Works on any file system with an atomic rename (HDFS, local); the driver lists partitions, never rows.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer committed first."""


def _files(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _text(jvm, fs, path) -> str:
    stream = fs.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def versions(spark: SparkSession, root: str) -> list[int]:
    jvm, fs = _files(spark, root)
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/_manifests")
    if not fs.exists(folder):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(folder))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """{"version", "by", "schema", "parts": {partition: data folder}} of the newest version, or of the one asked for."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{root}: no version {'' if version is None else version}")
    jvm, fs = _files(spark, root)
    return json.loads(_text(jvm, fs, jvm.org.apache.hadoop.fs.Path(f"{root}/_manifests/{known[-1] if version is None else version:012d}.json")))


def _partitions(jvm, fs, folder: str, depth: int) -> list[str]:
    """Partition paths (a=1/b=2) below a data folder, `depth` levels down."""
    found = [""]
    for _ in range(depth):
        found = [f"{p}/{f.getPath().getName()}".lstrip("/") for p in found for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}" if p else folder)) if f.isDirectory() and "=" in f.getPath().getName()]
    return found


def commit(df: DataFrame, root: str, by: tuple[str, ...] = (), whole: bool = False, base: int | None = None) -> int:
    """Writes `df` and makes it part of the table: its partitions (of the columns `by`) replace those of the same values, all others stay; without `by`, or if `whole`, it is the table. Returns the version.

    base: the version that this write was made from; if another one is newest by then, `Conflict`. Nothing changes unless the whole write succeeds.
    """
    spark = df.sparkSession
    known = versions(spark, root)
    start = (known[-1] if known else 0) if base is None else base
    folder = f"data-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(f"{root}/{folder}")
    jvm, fs = _files(spark, root)
    parts = {}
    if known and by and not whole:
        old = manifest(spark, root, start)
        if tuple(old["by"]) != tuple(by):
            raise ValueError(f"the table is partitioned by {old['by']}")
        parts = dict(old["parts"])
    parts.update({p: folder for p in _partitions(jvm, fs, f"{root}/{folder}", len(by))})
    body = json.dumps({"version": start + 1, "by": list(by), "schema": df.schema.json(), "parts": parts})
    Path = jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(Path(f"{root}/_manifests"))
    temporary, final = Path(f"{root}/_manifests/_{uuid.uuid4().hex}"), Path(f"{root}/_manifests/{start + 1:012d}.json")
    out = fs.create(temporary, False)
    out.write(bytearray(body.encode()))
    out.close()
    if fs.exists(final) or not fs.rename(temporary, final):
        fs.delete(temporary, False)
        raise Conflict(f"{root}: version {start + 1} exists")
    return start + 1


def table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest version of a table, or an older one; only the files that its manifest names are read."""
    from pyspark.sql.types import StructType

    m = manifest(spark, root, version)
    schema = StructType.fromJson(json.loads(m["schema"]))
    folders: dict[str, list[str]] = {}
    for part, folder in m["parts"].items():
        folders.setdefault(folder, []).append(part)
    read = lambda folder, parts: spark.read.schema(schema).option("basePath", f"{root}/{folder}").parquet(*(f"{root}/{folder}/{p}".rstrip("/") for p in sorted(parts)))
    frames = [read(f, p).select(*schema.names) for f, p in sorted(folders.items())]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes data folders that none of the newest `keep` versions names, and older manifests; returns how many folders. Only while nobody writes."""
    jvm, fs = _files(spark, root)
    Path = jvm.org.apache.hadoop.fs.Path
    known = versions(spark, root)
    used = {f for v in known[-keep:] for f in manifest(spark, root, v)["parts"].values()}
    stale = [f.getPath() for f in fs.listStatus(Path(root)) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in used]
    for p in stale:
        fs.delete(p, True)
    for v in known[:-keep]:
        fs.delete(Path(f"{root}/_manifests/{v:012d}.json"), False)
    return len(stale)


def failing(df: DataFrame, condition) -> DataFrame:
    """`df` whose reading fails at the first row that fulfils the condition: a write that dies half way, for tests and drills."""
    return df.where(F.when(condition, F.raise_error(F.lit("stopped half way")).cast("boolean")).otherwise(True))
