"""Merges into tables on disk and the cache of results: cut-off batches, repeats, late rows, two writers."""

import pytest
from pyspark.sql import functions as F

from quantloom.sources import merge, shared
from quantloom.sources.cache import ParquetCache


def rows(spark, data, kind="k int, v string, ver int"):
    return spark.createDataFrame(data, kind)


def table(spark, path):
    return {r.k: r.v for r in merge.read_table(spark, path).collect()}


def test_later_batches_replace_and_repeats_are_skipped(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    assert merge.merge_batch(rows(spark, [(1, "a", 1), (2, "b", 1), (None, "n", 1), (1, "c", 2)]), at, ["k"], "b1", order=["ver"])
    assert table(spark, at) == {1: "c", 2: "b", None: "n"}
    assert merge.merge_batch(rows(spark, [(2, "x", 0), (None, "m", 0), (3, "y", 0)]), at, ["k"], "b2", order=["ver"])
    want = {1: "c", 2: "x", 3: "y", None: "m"}
    assert table(spark, at) == want
    assert not merge.merge_batch(rows(spark, [(2, "b", 1)]), at, ["k"], "b1", order=["ver"])
    assert table(spark, at) == want


def test_the_greater_version_wins_over_a_late_batch(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    merge.merge_batch(rows(spark, [(1, "new", 5), (2, "old", 1), (3, "no version", None)]), at, ["k"], "b1", version="ver")
    merge.merge_batch(rows(spark, [(1, "late", 4), (2, "same", 1), (3, "some", 0)]), at, ["k"], "b2", version="ver")
    assert table(spark, at) == {1: "new", 2: "same", 3: "some"}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    merge.merge_batch(rows(spark, [(k, "a", 0) for k in range(200)]), at, ["k"], "b1", buckets=16)
    before = merge.buckets_of(spark, at)
    merge.merge_batch(rows(spark, [(7, "z", 0)]), at, ["k"], "b2", buckets=99)  # the number of the first batch holds
    after = merge.buckets_of(spark, at)
    assert before.keys() == after.keys() and len(before) == 16
    assert sum(before[b] != after[b] for b in before) == 1
    assert table(spark, at) == {k: "z" if k == 7 else "a" for k in range(200)}


@pytest.mark.parametrize("fails", ["copy", "mark"])
def test_a_batch_cut_off_ends_the_same_when_it_runs_again(spark, tmp_path, monkeypatch, fails):
    at = f"file://{tmp_path}/t"
    merge.merge_batch(rows(spark, [(k, "a", 0) for k in range(50)]), at, ["k"], "b1", buckets=4)
    real, calls = merge.names if fails == "copy" else merge.write_new, []

    def broken(*args):
        calls.append(args)
        if fails == "mark" and args[1].endswith("/batches/b2"):
            raise OSError("lost")
        if fails == "copy" and args[1].endswith("/stage/b2"):
            raise OSError("lost")
        return real(*args)

    monkeypatch.setattr(merge, "names" if fails == "copy" else "write_new", broken)
    with pytest.raises(OSError):
        merge.merge_batch(rows(spark, [(1, "b", 0), (99, "b", 0)]), at, ["k"], "b2")
    monkeypatch.undo()
    assert shared.exists(spark, f"{at}/stage/b2/_SUCCESS")
    assert merge.merge_batch(rows(spark, [(1, "b", 0), (99, "b", 0)]), at, ["k"], "b2")
    assert table(spark, at) == {k: "b" if k in (1, 99) else "a" for k in [*range(50), 99]}
    assert not shared.exists(spark, f"{at}/stage/b2")


def test_new_columns_and_empty_batches(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    merge.merge_batch(rows(spark, []), at, ["k"], "b0")
    assert merge.read_table(spark, at).columns == ["k", "v", "ver"] and merge.read_table(spark, at).count() == 0
    merge.merge_batch(rows(spark, [(k, "a", 0) for k in range(20)]), at, ["k"], "b1")
    merge.merge_batch(rows(spark, [(1, "b", 0, 0.5)], "k int, v string, ver int, w double"), at, ["k"], "b2")
    got = {r.k: r.w for r in merge.read_table(spark, at).collect()}
    assert got == {k: 0.5 if k == 1 else None for k in range(20)}


def test_retention_rewrites_and_can_empty_the_table(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    merge.merge_batch(rows(spark, [(k, "a", k if k else None) for k in range(40)]), at, ["k"], "b1", buckets=8)
    assert merge.retain(spark, at, F.col("ver") >= 30, "r1")
    assert sorted(table(spark, at)) == list(range(30, 40))
    assert not merge.retain(spark, at, F.col("ver") >= 35, "r1")
    assert merge.retain(spark, at, "false", "r2")
    assert merge.read_table(spark, at).count() == 0
    merge.merge_batch(rows(spark, [(1, "b", 0)]), at, ["k"], "b2")
    assert table(spark, at) == {1: "b"}


def test_cache_expires_and_drops_by_prefix(spark, tmp_path):
    now = [0.0]
    cache = ParquetCache(spark, f"file://{tmp_path}/c", clock=lambda: now[0])
    make = lambda n: lambda: spark.range(n)
    assert cache.get("a/x") is None
    assert cache.get_or_make("a/x", make(1), ttl=10).count() == 1
    now[0] = 10
    assert cache.get_or_make("a/x", make(2), ttl=10).count() == 1
    now[0] = 11
    assert cache.get("a/x", ttl=10) is None
    assert cache.get_or_make("a/x", make(3), ttl=10).count() == 3
    cache.put("a/y", spark.range(4))
    cache.put("b", spark.range(5))
    assert cache.keys("a/") == ["a/x", "a/y"]
    assert cache.invalidate("a/") == 2 and cache.invalidate("a/") == 0
    assert cache.get("a/x") is None and cache.get("b").count() == 5
    now[0] = 100
    assert cache.vacuum(50) == 3  # both generations of a/x, and a/y
    assert cache.get("b").count() == 5 and cache.get_or_make("a/x", make(6)).count() == 6


def test_of_two_writers_one_wins_and_both_read_it(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/c"
    one, two = ParquetCache(spark, root), ParquetCache(spark, root)
    newest = one._newest
    # The second writer takes the number while the first one still holds the old one.
    monkeypatch.setattr(one, "_newest", lambda key: (two.put(key, spark.range(7)), monkeypatch.setattr(one, "_newest", newest), (0, {"data": None, "made": 0}))[-1])
    assert one.put("k", spark.range(3)).count() == 7
    assert [n for n in shared.names(spark, f"{root}/k") if n.startswith("data-")].__len__() == 1
