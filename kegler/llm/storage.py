"""Shared storage: where operators cut lineage and put files that other executors must see.

Everything goes below the folder that the cluster names in ``spark.checkpoint.dir``. Only on one
machine (a local master), as in tests, may that be unset: then a temporary folder takes its place.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI that means the same to Spark and to pyarrow: one without a scheme is one of Spark's
    default file system, wherever that is."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by the driver and all executors."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return qualified(spark, base)
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="kegler-shared-"))
    return _OWN[0]


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path, used by nobody else, below the shared folder."""
    return f"{shared_dir(spark)}/kegler/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path that ``work_path`` made, once nothing reads it any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once what was made of them is written itself."""
    for table in tables:
        drop_path(table.sparkSession, table.shared_path)


class Scratch(list):
    """Tables that an operator needs only while it works."""

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        self.append(materialize(df, tag))
        return self[-1]

    def drop(self) -> None:
        discard(*self)
        self.clear()


def open_fs(path: str):
    """The pyarrow file system of a URI and the path in it; works on executors, without Spark."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        raise ValueError(f"{path} has no scheme: name the file system, as in file:///shared or hdfs://host/shared")
    return fs.FileSystem.from_uri(path)
