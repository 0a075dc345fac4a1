"""Keyed streams over several micro-batches against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom.streaming import snapshots, stateful

T0 = dt.datetime(2024, 1, 1)
KIND = "event_id long, ts timestamp, user_id long, action string, value double"


def events(n, users, hours, seed):
    rng = random.Random(seed)
    times = sorted(rng.randrange(hours * 3600) for _ in range(n))
    return [(i, T0 + dt.timedelta(seconds=s), rng.choice(users), rng.choice(["take", "take", "ack", "other"]), rng.random()) for i, s in enumerate(times)]


def as_stream(spark, rows, tmp_path, parts):
    """Files in order of time, read one in a micro-batch."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        part = rows[k * size : (k + 1) * size]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return snapshots.read_events(spark, f"{tmp_path}/in", pattern="*.parquet")


def requeued_by_hand(rows, visible, end):
    out, state = [], {}
    for i, ts, user, action, _ in rows:
        if user is None or ts is None:
            continue
        started, tries = state.get(user, (None, 0))
        if started is not None and ts > started + visible:
            tries += 1
            out.append((user, started + visible, tries))
            started = None
        if action == "take":
            started = ts
        elif action == "ack":
            started, tries = None, 0
        state[user] = (started, tries)
    for user, (started, tries) in state.items():
        if started is not None and started + visible < end:
            out.append((user, started + visible, tries + 1))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 4])
def test_tasks_go_back_whatever_the_batches(spark, tmp_path, parts):
    rows = events(400, range(8), 60, seed=parts)
    rows[5] = (5, rows[5][1], None, "take", 0.0)
    stream = stateful.requeued(as_stream(spark, rows, tmp_path, parts), "user_id", "ts", "event_id", "action", "30 minutes")
    got = stateful.run_to_table(stream, f"{tmp_path}/out").collect()
    visible = dt.timedelta(minutes=30)
    want = requeued_by_hand(rows, visible, rows[-1][1])
    us = lambda t: round((t - T0).total_seconds() * 1e6)
    base = 1704067200 * 10**6
    assert sorted((r.task, r.at - base, r.tries) for r in got) == [(u, us(t), k) for u, t, k in want]
    assert max(k for _, _, k in want) > 1


@pytest.mark.parametrize("parts", [1, 3])
def test_the_snapshot_starts_from_history(spark, tmp_path, parts):
    rows = events(300, range(6), 48, seed=9)
    past = [(1000 + k, T0 - dt.timedelta(hours=k + 1), k % 9, "other", float(k)) for k in range(30)]
    past += [(2000, T0 + dt.timedelta(days=9), 5, "other", -1.0), (2001, None, 8, "other", 1.0), (2002, T0, None, "other", 1.0)]
    history = spark.createDataFrame(past, KIND)
    stream = stateful.bootstrapped_snapshot(as_stream(spark, rows, tmp_path, parts), history, "user_id", "ts", "event_id", "value", stale="20 hours")
    got = stateful.run_to_table(stream, f"{tmp_path}/out").collect()
    # Keys 6 to 8 come from history alone and are reported once; key 5 has a state from the future, which no quote replaces.
    newest = {k: max((r for r in past if r[2] == k and r[1] is not None), key=lambda r: (r[1], r[0])) for k in range(9)}
    for k in (6, 7, 8):
        assert [(r.id, r.value, r.source, r.kind) for r in got if r.key == k] == [(newest[k][0], newest[k][4], "history", "stale")]
    assert [r for r in got if r.key == 5] == []
    for k in range(5):
        own = sorted((r for r in got if r.key == k and r.kind == "quote"), key=lambda r: r.at)
        last = max((r for r in rows if r[2] == k), key=lambda r: (r[1], r[0]))
        assert own[-1].id == last[0] and own[-1].value == last[4] and 1 <= len(own) <= parts


def test_the_store_setting_comes_back(spark):
    before = spark.conf.get(stateful.STORE, None)
    with pytest.raises(RuntimeError), stateful.keyed_store(spark):
        assert spark.conf.get(stateful.STORE) == stateful.ROCKS
        raise RuntimeError
    assert spark.conf.get(stateful.STORE, None) == before


def test_merging_a_stream_keeps_the_newest(spark, tmp_path):
    from quantloom.sources import merge

    rows = events(200, range(5), 40, seed=3)
    stream = as_stream(spark, rows, tmp_path, 3).withColumn("version", F.struct("ts", "event_id"))
    for _ in range(2):  # the second run has nothing new to merge
        merge.merge_stream(stream, f"file://{tmp_path}/t", ["user_id"], f"file://{tmp_path}/c", version="version").awaitTermination()
    got = {r.user_id: r.event_id for r in merge.read_table(spark, f"file://{tmp_path}/t").collect()}
    assert got == {u: max(r[0] for r in rows if r[2] == u) for u in range(5)}
