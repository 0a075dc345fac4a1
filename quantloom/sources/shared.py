"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of its own only on a local master where the setting is missing."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "quantloom-shared")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and the path in its form."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none where it isn't there."""
    fs, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that must not be there yet; False where another writer was first."""
    fs, at = file_system(spark, path)
    try:
        out = fs.create(at, False)
    except Exception as e:  # py4j wraps the store's own kind
        if fs.exists(at):
            return False
        raise OSError(f"cannot write {path}") from e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path; what is written there goes when the session ends."""
    path = f"{shared_dir(spark)}/quantloom/{name}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, for what several steps read: it isn't computed again."""
    path = f"{scratch(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
