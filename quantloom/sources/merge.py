"""Keyed merges into a Parquet table on disk, partitioned by a hash bucket of the key.

A batch rewrites only the buckets that its keys fall into: these are read (the others are pruned by partition), merged
with the batch in one shuffle by key, and replaced by dynamic partition overwrite. The merged buckets are first written
whole beside the table and then copied in, so a batch that is cut off anywhere and run again ends the same: the copy
starts over from what was merged, or the merge starts over from a table that it hasn't touched yet. A batch that is
marked as done is skipped. One writer at a time; readers see the table before or after, bucket by bucket.

The number of buckets is fixed by the first batch and kept in the table's own folder. Choose it so that a bucket is a
task's worth of data; keys spread over buckets by hash, so a frequent key is one row however often it comes.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.operators.relational import latest

from .shared import delete, exists, file_system, names, write_new

BUCKETS = 32
_BUCKET, _NEW = "__bucket", "__new"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows. Columns that came with later batches are null in older rows."""
    if any(f.startswith(_BUCKET) for f in names(spark, f"{path}/data")):
        return spark.read.option("mergeSchema", "true").parquet(f"{path}/data").drop(_BUCKET)
    return spark.createDataFrame([], StructType.fromJson(json.loads(spark.read.text(f"{path}/schema.json").first()[0])))


def _buckets(spark: SparkSession, path: str, wanted: int) -> int:
    at = f"{path}/buckets.json"
    write_new(spark, at, json.dumps({"buckets": wanted}))
    return json.loads(spark.read.text(at).first()[0])["buckets"]


def merge_batch(new: DataFrame, path: str, keys: list[str], batch: str, order: list[str] | None = None, version: str | None = None, buckets: int = BUCKETS) -> bool:
    """Puts the rows of ``new`` in place of those with equal keys (nulls are equal). Returns False where the batch was merged before.

    Of rows with equal keys inside a batch the one that comes last by ``order`` counts. Between batches the later batch
    wins; with ``version`` the row whose version is greater, the new one of equal versions.
    """
    spark = new.sparkSession
    done, stage = f"{path}/batches/{batch}", f"{path}/stage/{batch}"
    if exists(spark, done):
        return False
    if not exists(spark, f"{stage}/_SUCCESS"):
        n = _buckets(spark, path, buckets)
        write_new(spark, f"{path}/schema.json", new.schema.json())
        rank = [F.desc_nulls_last(c) for c in [*([version] if version else []), *(order or [])]] or [F.desc(k) for k in keys]
        fresh = latest(new, keys, rank).withColumn(_NEW, F.lit(1)).withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
        touched = [r[0] for r in fresh.select(_BUCKET).distinct().collect()]  # as many as there are buckets at most
        if any(f.startswith(_BUCKET) for f in names(spark, f"{path}/data")):
            old = spark.read.option("mergeSchema", "true").parquet(f"{path}/data").where(F.col(_BUCKET).isin(touched))
            both = old.withColumn(_NEW, F.lit(0)).unionByName(fresh, allowMissingColumns=True)
            fresh = latest(both, keys, [*([F.desc_nulls_last(version)] if version else []), F.desc(_NEW)])
        # Rebalanced by bucket: few files each, a large bucket in several tasks.
        fresh.drop(_NEW).hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(stage)
    if any(f.startswith(_BUCKET) for f in names(spark, stage)):
        merged = spark.read.parquet(stage)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(f"{path}/data")
    write_new(spark, done, "")
    delete(spark, stage)
    return True


def buckets_of(spark: SparkSession, path: str) -> dict[str, int]:
    """When each bucket's folder was last written, in milliseconds: what a batch left alone keeps its time."""
    fs, at = file_system(spark, f"{path}/data")
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(at) if s.isDirectory()}


def merge_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order: list[str] | None = None, version: str | None = None):
    """A stream's micro-batches merged one after another; a batch that the engine repeats is skipped by its number."""
    put = lambda batch, number: merge_batch(batch, path, keys, f"stream-{number}", order, version) and None
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retain(spark: SparkSession, path: str, keep: Column | str, batch: str) -> bool:
    """Rewrites the buckets that hold a row for which ``keep`` isn't true, without these rows. Idempotent by ``batch``."""
    done, stage = f"{path}/batches/{batch}", f"{path}/stage/{batch}"
    if exists(spark, done):
        return False
    keep = F.coalesce(F.expr(keep) if isinstance(keep, str) else keep, F.lit(False))
    if not exists(spark, f"{stage}/_SUCCESS"):
        table = spark.read.option("mergeSchema", "true").parquet(f"{path}/data")
        touched = [r[0] for r in table.where(~keep).select(_BUCKET).distinct().collect()]
        write_new(spark, f"{path}/stage/{batch}.json", json.dumps(touched))
        table.where(F.col(_BUCKET).isin(touched) & keep).hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(stage)
    left = {f for f in names(spark, stage) if f.startswith(_BUCKET)}
    if left:
        spark.read.parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(f"{path}/data")
    # Dynamic overwrite leaves a bucket of which nothing stays.
    for k in json.loads(spark.read.text(f"{path}/stage/{batch}.json").first()[0]):
        if f"{_BUCKET}={k}" not in left:
            delete(spark, f"{path}/data/{_BUCKET}={k}")
    write_new(spark, done, "")
    delete(spark, stage)
    delete(spark, f"{path}/stage/{batch}.json")
    return True
