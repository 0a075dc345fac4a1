"""Near copies of documents: SimHash and its trie, with an exact self-join of the sets of five-word shingles for the rest.

Words are cut as for the SimHash (A-Z lower-cased, split at white space). A document's set holds the XXH64 hashes of its
windows of SHINGLE words (of the whole sequence if there are fewer). Two documents are linked if their sets' Jaccard
similarity is at least 0.8. Of every connected group the first document, by (doc_id, text), stays.

SimHash: each distinct set has a fingerprint of 64 bits, the majority of its hashes. The trie of ``simhash.py`` groups fingerprints
that are linked within BITS bits. The members of a group meet its first one, and those that are similar enough, by the sets
themselves, are linked.

The rest: at a similarity of 0.8 fingerprints differ in some ten bits, which no trie can look for among millions. All links
between the groups made so far are found by a prefix filter, so that the result is the exact one whatever BITS is.

Prefix filter: sets of that similarity share at least 4/5 of either one's n shingles, so under any one order of all
shingles their first ``n // 5 + 1`` have one in common. No link is lost to it, whichever the order. Rare shingles come
first here, which keeps chance candidates few: shingles that more than COMMON of every SPARSE-th set (by its hash) hold in the
lower half of their hashes are ranked by the number of these sets, all others by hash alone. Only the order, and so the time
but no result, depends on that sample. The table of common shingles is bounded by raising COMMON, which only costs time.

Sketches: before sets are compared in full, pairs are sifted by parity bitmaps of some n bits (which shingles, by their low hash
bits, fall into each bit an odd number of times). Two bitmaps differ in no more bits than the sets do in shingles, and sets of
that similarity differ in a ninth of their sizes' sum at most, so no link is lost to them either.

Crowded prefixes: the members of a shingle are compared with its first and last member alone. Members that this leaves in
different groups are then compared with one another, so no link between groups is lost.

Nulls: a null text counts as empty, and all documents without words are copies of one another. A null doc_id ranks first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, clean_columns, drop_stage, small_batches, staged
from .components import connected_components
from .simhash import MOST_SENT, first_of_each, majority, shingle_hashes, text_key, trie_join

SHINGLE, BITS = 5, 3
COMMON, SPARSE, MOST_COMMON = 4, 8, 1 << 19


def sketch(grams: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set, in words of 64 bits: of as many bits as the set has shingles, up to the next power of two."""
    bits = 1 << max(6, (len(grams) - 1).bit_length() if len(grams) else 0)
    odd = np.bincount(grams & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def bits_apart(a: str, b: str) -> Column:
    """In how many bits two bitmaps differ, of which one may have twice the other's length: it is folded, which keeps parities."""
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda x: (F.size(x) / 2).cast("int")
    fold = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), xor)
    shorter = lambda x, y: F.when(F.size(x) > F.size(y), fold(x)).otherwise(F.col(x))
    each = F.zip_with(shorter(a, b), shorter(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(each, F.lit(0), lambda t, x: t + x)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key``, ``cls`` (the identity of the set), ``grams`` (the sorted set), its ``sketch``, fingerprint ``fp`` and size ``n`` of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, SHINGLE).view(np.int64)) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
            cls = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            marks = pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
            fp = np.fromiter((majority(np.split(s, range(1 << 16, len(s), 1 << 16))) for s in sets), np.uint64, len(sets)).view(np.int64)
            cols = [b.column(0), b.column(2), cls, grams, marks, pa.array(fp), pa.array(np.diff(ends).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "cls", "grams", "sketch", "fp", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = clean_columns(docs, "doc_id", "text").withColumn("key", text_key())
    return cut.mapInArrow(run, f"doc_id {kind}, key long, cls binary, grams array<long>, sketch array<long>, fp long, n long")


def _common(sets: DataFrame, common: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that more than ``common`` of the sampled sets hold in their lower half, sorted, and in how many each stands."""
    half = F.slice("grams", 1, F.floor(F.size("grams") / 2).cast("int") + 1)
    some = sets.where(F.pmod(F.xxhash64("cid"), F.lit(SPARSE)) == 0)
    counts = some.select(F.explode(half).alias("g")).groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > common)
    counts = staged(counts, "near-common")
    while counts.where(F.col("c") > common).count() > most:
        common *= 2
    t = counts.where(F.col("c") > common).toArrow()
    drop_stage(counts)
    g, c = t.column("g").to_numpy(), t.column("c").to_numpy()
    order = np.argsort(g)
    return g[order], c[order]


def prefixes(sets: DataFrame, common: int = COMMON, most: int = MOST_COMMON) -> DataFrame:
    """``g``, ``cid``, ``n``: the first shingles of each set of ``n``."""
    sent = sets.sparkSession.sparkContext.broadcast(_common(sets, common, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for b in batches:
            grams = b.column(1)
            flat = grams.flatten().to_numpy()
            size = np.diff(grams.offsets.to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            rank = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                rank = np.where(known[at] == flat, counts[at], 0)
            order = np.lexsort((flat, rank, row))
            first = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) <= size[row] // 5
            take, row = order[first], row[first]
            cid = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(flat[take]), pa.array(cid[row]), pa.array(size[row])], ["g", "cid", "n"])

    return sets.select("cid", "grams").mapInArrow(run, "g long, cid long, n long")


def _sendable(df: DataFrame) -> DataFrame:
    """``df`` (staged, small rows), marked for broadcasting if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def _alike(a: str, b: str) -> Column:
    """Sets of such sizes can be similar enough."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _sifted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a, b, na, nb``) whose bitmaps allow a similarity of 0.8, as ``a``, ``b``."""
    a = sets.select(F.col("cid").alias("a"), F.col("sketch").alias("sa"))
    b = sets.select(F.col("cid").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(a, "a").join(b, "b").where(9 * bits_apart("sa", "sb") <= F.col("na") + F.col("nb")).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, work: Stages) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``; staged) with a similarity of at least 0.8, as ``u``, ``v``, staged."""
    ids = work.staged(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), "near-wanted")
    sets = sets.select("cid", "grams").join(_sendable(ids), "cid")  # most sets are in no pair and stay where they are
    a = sets.select(F.col("cid").alias("a"), F.col("grams").alias("ga"))
    b = sets.select(F.col("cid").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    near = pairs.join(a, "a").join(b, "b").where(9 * both >= 4 * (F.size("ga") + F.size("gb")))
    return work.staged(near.select(F.col("a").alias("u"), F.col("b").alias("v")), "near-links")


def _linked_in_rounds(pairs: DataFrame, sets: DataFrame, work: Stages) -> DataFrame:
    """Links among ``pairs`` that connect the same groups as all of them do: each set meets its least partner first, and only pairs
    that this leaves in different groups are looked at after that."""
    least = work.staged(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "near-least")
    first = _linked(least, sets, work)
    roots = work.hold(connected_components(first))
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    apart = pairs.join(least, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = apart.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    return first.union(_linked(work.staged(apart, "near-apart"), sets, work))


def simhash_links(sets: DataFrame, work: Stages, bits: int = BITS) -> DataFrame:
    """Links ``u``, ``v`` (staged) of sets with a similarity of at least 0.8 that the trie of their fingerprints finds: each set
    is compared with the first of its group. ``sets``: ``cid, grams, sketch, fp, n`` of the distinct sets."""
    prints = work.staged(sets.select("cid", "fp", "n"), "near-prints")
    values = work.staged(prints.select("fp").distinct(), "near-values")
    roots = work.hold(connected_components(trie_join(values, bits)))
    placed = prints.join(roots, F.col("fp") == F.col("node"), "left").select("cid", "n", F.coalesce("root", "fp").alias("root"))
    placed = work.staged(placed, "near-grouped")
    first = placed.groupBy("root").agg(F.min(F.struct("cid", "n")).alias("lo"), F.count("*").alias("c")).where("c > 1").select("root", "lo")
    met = placed.join(_sendable(work.staged(first, "near-firsts")), "root").where("cid <> lo.cid")
    pairs = met.select(F.col("lo.cid").alias("a"), F.col("lo.n").alias("na"), F.col("cid").alias("b"), F.col("n").alias("nb")).where(_alike("na", "nb"))
    return _linked(work.staged(_sifted(pairs, sets), "near-met"), sets, work)


def jaccard_links(sets: DataFrame, known: DataFrame, work: Stages, common: int = COMMON, most: int = MOST_COMMON) -> DataFrame:
    """Links ``u``, ``v`` that connect the groups of similar sets: those ``known`` and, between their groups, all others that it
    takes. ``sets``: ``cid, grams, sketch`` of the distinct sets. What it stages goes with ``work``."""
    keyed = staged(prefixes(sets, common, most), "near-prefixes")
    # Most shingles have one set: the shingles alone are counted first.
    shared = keyed.select("g").groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g", (F.col("c") > 2).alias("crowded"))
    shared = _sendable(work.staged(shared, "near-shared"))
    members = work.staged(keyed.join(shared, "g"), "near-members")
    drop_stage(keyed)
    member = F.struct("cid", "n")
    ends = members.groupBy("g", "crowded").agg(F.min(member).alias("lo"), F.max(member).alias("hi"))
    ends = work.staged(ends, "near-ends")
    two = ends.select("crowded", F.col("lo.cid").alias("a"), F.col("lo.n").alias("na"), F.col("hi.cid").alias("b"), F.col("hi.n").alias("nb"))
    leaders = _sendable(work.staged(ends.where("crowded").select("g", "lo", "hi"), "near-leaders"))
    crowd = work.staged(members.where("crowded").select("g", "cid", "n").join(leaders, "g"), "near-crowd")
    led = crowd.where("cid <> lo.cid").select(F.col("lo.cid").alias("a"), F.col("lo.n").alias("na"), F.col("cid").alias("b"), F.col("n").alias("nb"))
    last = crowd.where("cid <> hi.cid").select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("hi.cid").alias("b"), F.col("hi.n").alias("nb"))
    pairs = two.where(~F.col("crowded")).drop("crowded").union(led).union(last).where(_alike("na", "nb"))
    group = work.hold(connected_components(known))
    in_group = lambda x: group.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    pairs = pairs.distinct().join(in_group("a"), "a", "left").join(in_group("b"), "b", "left")
    pairs = pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "na", "b", "nb")
    pairs = work.staged(_sifted(pairs, sets), "near-pairs")
    first = known.union(_linked_in_rounds(pairs, sets, work))
    roots = work.hold(connected_components(first)).withColumnRenamed("node", "cid")
    placed = crowd.select("g", "cid", "n").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    placed = work.staged(placed, "near-placed")
    split = placed.groupBy("g").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("g")
    open_ = work.staged(placed.join(split, "g"), "near-open")
    mine = open_.select("g", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    other = open_.select("g", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    rest = mine.join(other, "g").where((F.col("ra") < F.col("rb")) & _alike("na", "nb"))
    low = F.col("a") < F.col("b")
    ordered = [F.when(low, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))]
    rest = _sifted(rest.select(*ordered).distinct(), sets)
    rest = work.staged(rest.join(pairs, ["a", "b"], "left_anti"), "near-rest")
    return first if rest.isEmpty() else first.union(_linked(rest, sets, work))


def keep_one(docs: DataFrame, common: int = COMMON, most: int = MOST_COMMON) -> DataFrame:
    """``docs`` without the documents that have an earlier one, by (doc_id, text), in their group. All columns are kept."""
    work = Stages()
    rows = work.staged(shingle_sets(docs).withColumn("rid", F.monotonically_increasing_id()), "near-sets")
    classes = work.staged(rows.groupBy("cls").agg(F.min("rid").alias("cid")), "near-classes")
    ids = work.staged(rows.select("doc_id", "key", "rid", "cls").join(classes, "cls").select("doc_id", "key", "rid", "cid"), "near-ids")
    again = _sendable(work.staged(ids.where("rid <> cid").select("rid"), "near-again"))
    sets = rows.select("rid", "grams", "sketch", "fp", "n").join(again, "rid", "left_anti").withColumnRenamed("rid", "cid")
    roots = work.hold(connected_components(jaccard_links(sets, simhash_links(sets, work), work, common, most)))
    rooted = ids.join(roots, F.col("cid") == F.col("node"), "left").select("doc_id", "key", F.coalesce("root", "cid").alias("root"))
    rooted = staged(rooted, "near-rows")
    work.drop()
    return first_of_each(docs, rooted)
