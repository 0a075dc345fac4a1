"""Structured Streaming: keyed snapshots, windowed counts, sessions and deduplication over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quantloom.functions.scalar import trading_time
from quantloom.operators.relational import latest, upsert


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1, pattern: str = "events.parquet") -> DataFrame:
    """The Parquet files at ``path`` as a stream, with the schema of those that are there; watermarks need zoned times."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    t = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(path)
    return t.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def in_trading_hours(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.where(trading_time(F.col(ts)))


def tumbling(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 day", late: str = "1 day") -> DataFrame:
    t = events.withWatermark(ts, late).groupBy(F.window(ts, width), key)
    return t.agg(F.count("*").alias("n"), F.max("value").alias("hi")).select(F.col("window.start").alias("start"), key, "n", "hi")


def sliding(events: DataFrame, ts: str = "ts", key: str = "user_id", width: str = "60 minutes", step: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts over sliding windows: the rate limiter's view."""
    t = events.withWatermark(ts, late).groupBy(F.window(ts, width, step), key)
    return t.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    t = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key)
    return t.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def snapshot(events: DataFrame, path: str, keys: list[str], version: str, checkpoint: str) -> StreamingQuery:
    """Keeps at ``path`` the row of each key with the highest ``version``. Each batch writes a generation of its own.

    A batch that is run again overwrites its generation from the one before, so the merge is idempotent.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, [F.desc(version)])
        before = f"{path}/generation={number - 1}"
        if number:
            new = upsert(spark.read.schema(batch.schema).parquet(before), new, keys, version)
        new.write.mode("overwrite").parquet(f"{path}/generation={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that the stream gives now, as a table in memory: for tests and small results only."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
