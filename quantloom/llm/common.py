"""Shared pieces: staged tables in the cluster's shared folder, and text helpers.

A stage table cuts lineage: it is written once through Spark's own committer to ``spark.checkpoint.dir`` and read
back, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the bytes 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is set here only for a local master without one."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "quantloom-stages")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quantloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Deletes a stage table that no later plan reads."""
    if path := getattr(df, "_stage_path", None):
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


class Stages:
    """Stage tables that are deleted together once nothing reads them any more."""

    def __init__(self) -> None:
        self._held: list[DataFrame] = []

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        self._held.append(staged(df, name))
        return self._held[-1]

    def hold(self, df: DataFrame) -> DataFrame:
        self._held.append(df)
        return df

    def drop(self) -> None:
        while self._held:
            drop_stage(self._held.pop())


#: Bytes of rows, as counted, that are sent to every task; more are joined by a shuffle.
MOST_SENT_BYTES = 32 << 20


def sendable(df: DataFrame, row_bytes: int, more: int = 0) -> DataFrame:
    """``df`` (staged), marked for broadcasting if its counted rows of ``row_bytes`` and ``more`` bytes besides are few."""
    return F.broadcast(df) if df.count() * row_bytes + more <= MOST_SENT_BYTES else df


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most ``rows`` rows, so that a run of very long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def clean_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: callers may bring others, whose names can clash with those that operators add."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on after a task, and its next one starts from here."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
