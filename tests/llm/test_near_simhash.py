"""The near-copy stage goes through the SimHash trie; what its bits can't reach is found all the same."""

import random
import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, "/root/repo")

import corpus_pipeline
from quantloom.llm import near_copies, simhash
from quantloom.llm.common import Stages


def texts():
    """Thirty texts, each with a copy that differs in its last word and one with every twelfth word of its last third replaced."""
    rng = random.Random(3)
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        other = [f"x{rng.randrange(5000)}" if k > 270 and k % 22 == 0 else w for k, w in enumerate(words)]
        yield words, [*words[:-1], "end"], other


def bits(a, b):
    return (simhash.majority([near_copies.shingle_hashes(a, 5)]) ^ simhash.majority([near_copies.shingle_hashes(b, 5)])).bit_count()


def test_near_copies_are_linked_by_the_trie_and_the_rest(spark, monkeypatch):
    rows = [" ".join(t) for three in texts() for t in three]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    asked = []
    join = near_copies.trie_join

    def spied(values, budget):
        asked.append(budget)
        return join(values, budget)

    monkeypatch.setattr(near_copies, "trie_join", spied)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert asked == [near_copies.BITS]
    assert kept == list(range(0, 90, 3))
    # Some copies lie beyond the bits, so the rest did work too.
    apart = [bits(rows[k], rows[k + 2]) for k in range(0, 90, 3)]
    assert max(apart) > near_copies.BITS


def test_links_of_the_trie_are_similar_sets(spark):
    rows = [" ".join(t) for three in texts() for t in three]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    work = Stages()
    sets = work.staged(near_copies.shingle_sets(docs).withColumn("cid", F.col("doc_id")), "test-sets")
    own = {r.cid: set(r.grams) for r in sets.select("cid", "grams").collect()}
    assert {r.cid: (r.fp % 2**64, r.n) for r in sets.collect()} == {k: (simhash.majority([np.array(sorted(s))]), len(s)) for k, s in own.items()}
    found = {(r.u, r.v) for r in near_copies.simhash_links(sets, work).collect()}
    work.drop()
    near = [(k, k + 1) for k in range(0, 90, 3) if bits(rows[k], rows[k + 1]) <= near_copies.BITS]
    assert len(near) > 25 and set(near) <= found
    assert all(9 * len(own[u] & own[v]) >= 4 * (len(own[u]) + len(own[v])) for u, v in found)


def test_values_lie_in_as_many_leaves_however_many_there_are(spark):
    rng, copies = np.random.default_rng(4), {}
    for n in (1 << 10, 1 << 14):
        fps = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        near = fps[: n // 8].view(np.uint64) ^ np.uint64((1 << 1) | (1 << 30) | (1 << 60))  # a bit in three of the four blocks
        df = spark.createDataFrame([(int(x),) for x in np.concatenate([fps, near.view(np.int64)])], "fp long")
        leaves = simhash.trie_leaves(df, df.count(), 3, 64)
        copies[n] = leaves.count() / df.count()
        assert leaves.groupBy("path", "depth", "prefix").count().agg(F.max("count")).first()[0] <= 64
        found = {frozenset((r.u, r.v)) for r in simhash.trie_join(df, 3, 64).collect()}
        assert found == {frozenset((int(a), int(b))) for a, b in zip(fps, near.view(np.int64))}
    assert copies[1 << 10] == copies[1 << 14] == 4


def test_values_that_share_a_block_are_turned_again(spark):
    """A crowd that no prefix of one block can cut: three thousand values that agree in their leading 40 bits."""
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 24, 3000)) | (0x5A5A5A5A5A << 24)
    df = spark.createDataFrame([(int(x),) for x in fps.astype(np.uint64).view(np.int64)], "fp long")
    us, vs = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    want = simhash.spanning(us, vs)
    found = simhash.trie_join(df, 2, 128).collect()
    at = {int(x): k for k, x in enumerate(fps.astype(np.uint64).view(np.int64))}
    got = simhash.spanning(np.array([at[r.u] for r in found]), np.array([at[r.v] for r in found]))
    assert all(np.array_equal(a, b) for a, b in zip(want, got))
