"""Keyed state machines over streams: a quote snapshot that starts from history, and a task queue with visibility timeouts.

Both keep one small state a key in the state store and act on event time, so their results don't depend on how the rows
are cut into micro-batches. The queue sorts a key's rows of one micro-batch in its task; a trigger's size bounds them. Rows
are handed over as such: a pandas frame for each key and call costs more than the work in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """State on disk, which keyed state machines need; the session's own setting comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before is not None else spark.conf.unset(STORE)


def _sorted(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.at, r.id))


SNAPSHOT = "key {key}, at long, id long, value double, source string, kind string"


class Snapshot(StatefulProcessor):
    """The newest quote of a key. The first state may come from history; a state that no quote replaces for ``stale`` microseconds is reported once."""

    def __init__(self, stale: int) -> None:
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "at long, id long, value double, source string")

    def _set(self, old: int | None, at: int, id: int, value: float, source: str) -> None:
        if old is not None:
            self.handle.deleteTimer(self._due(old))
        self.state.update((at, id, value, source))
        self.handle.registerTimer(self._due(at))

    def _due(self, at: int) -> int:
        return (at + self.stale) // 1000 + 1

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState
        self._set(None, r.at, r.id, r.value, "history")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = max(((r.at, r.id, r.value) for r in rows), key=lambda x: x[:2], default=None)
        if new is None:
            return
        old = self.state.get()
        if old is None or new[:2] > tuple(old[:2]):
            self._set(old[0] if old else None, *new, "quote")
            yield Row(key=key[0], at=new[0], id=new[1], value=new[2], source="quote", kind="quote")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, id, value, source = self.state.get()
        yield Row(key=key[0], at=at, id=id, value=value, source=source, kind="stale")


def _microseconds(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def bootstrapped_snapshot(quotes: DataFrame, history: DataFrame, key: str, ts: str, id: str, value: str, stale: str = "1 day", late: str = "0 seconds") -> DataFrame:
    """Changes of the snapshot as a stream: ``key, at, id, value, source, kind``.

    ``history`` (a table) gives the state that keys start from, its newest row each; quotes replace it if they are newer,
    by time and id. ``kind`` is quote for a new state and stale for one that grew ``stale`` old by the watermark; ``source`` says
    where the state came from. Rows with a null key, time or value don't count.
    """
    spark = quotes.sparkSession
    kind = quotes.schema[key].dataType.simpleString()
    shaped = lambda t: t.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull())
    columns = [F.col(key).alias("key"), _microseconds(ts).alias("at"), F.col(id).cast("long").alias("id"), F.col(value).cast("double").alias("value")]
    newest = shaped(history).select(*columns).groupBy("key").agg(F.max_by(F.struct("at", "id", "value"), F.struct("at", "id")).alias("r")).select("key", "r.*")
    t = shaped(quotes).withWatermark(ts, late).select(F.col(ts), *columns)
    length = spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {stale}")).alias("n")).first().n
    return t.groupBy("key").transformWithState(
        statefulProcessor=Snapshot(length), outputStructType=SNAPSHOT.format(key=kind), outputMode="Append", timeMode="EventTime", initialState=newest.groupBy("key")
    )


QUEUE = "task {key}, at long, tries long, started long"


class Queue(StatefulProcessor):
    """A task that is taken and not acknowledged in ``visible`` microseconds goes back to the queue."""

    def __init__(self, visible: int) -> None:
        self.visible = visible

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "started long, tries long")

    def _timer(self, started: int) -> int:
        return (started + self.visible) // 1000 + 1

    def _put(self, old: int, started: int, tries: int) -> None:
        if old >= 0:
            self.handle.deleteTimer(self._timer(old))
        if started >= 0:
            self.handle.registerTimer(self._timer(started))
        self.state.update((started, tries))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old, tries = self.state.get() or (-1, 0)
        started = old
        for r in _sorted(rows):
            # What the timer would have done before this row's time, whether or not it has fired.
            if started >= 0 and r.at > started + self.visible:
                tries += 1
                yield Row(task=key[0], at=started + self.visible, tries=tries, started=started)
                started = -1
            if r.action == "take":
                started = r.at
            elif r.action == "ack":
                started, tries = -1, 0
        self._put(old, started, tries)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        started, tries = self.state.get()
        self.state.update((-1, tries + 1))
        yield Row(task=key[0], at=started + self.visible, tries=tries + 1, started=started)


def requeued(events: DataFrame, task: str, ts: str, id: str, action: str, visible: str = "30 minutes", late: str = "0 seconds") -> DataFrame:
    """Tasks that go back to the queue, as a stream: ``task, at`` (microseconds), ``tries`` since the last acknowledgement, ``started``.

    ``action`` is take, ack or anything else, which changes nothing. Taking a task again starts its time anew; an
    acknowledgement at the last moment counts. Rows with a null task or time don't count.
    """
    spark = events.sparkSession
    kind = events.schema[task].dataType.simpleString()
    t = events.where(F.col(task).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    t = t.select(F.col(ts), F.col(task).alias("task"), _microseconds(ts).alias("at"), F.col(id).cast("long").alias("id"), F.col(action).alias("action"))
    length = spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {visible}")).alias("n")).first().n
    return t.groupBy("task").transformWithState(statefulProcessor=Queue(length), outputStructType=QUEUE.format(key=kind), outputMode="Append", timeMode="EventTime")


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Runs the stream over what is there now and returns its rows from the Parquet sink at ``path``."""
    spark = stream.sparkSession
    with keyed_store(spark):
        q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
