"""SimHash near-dedup: 64-bit fingerprints, and a self-join of the binary trie of their distinct values.

Fingerprint: the text with A-Z lower-cased is cut into words; each window of three words (the whole sequence if
there are fewer), joined by spaces, is hashed by XXH64 with seed 42, repeats included. Bit i is set if it is set in
over half of the hashes. A text without words has fingerprint zero.

Join: of ``budget`` + 1 blocks of bits, two fingerprints that differ in at most ``budget`` bits have one in common. The distinct
fingerprints form a binary trie for each block, with that block's bits in front, in which linked values lie under one
prefix: a value is in as many leaves as there are blocks, however many values and leaves there are. The tops of the tries are
cut into leaves of a bounded number of values (a crowded prefix is cut deeper; one that is crowded by values with the whole
block in common is turned again, by blocks of its other bits), and each leaf is one group. Inside a group the descent goes
on in numpy over whole frontiers of node pairs: the differing bits add up, and a pair of nodes is dropped as soon as they
exceed the budget, or lie in the block. A task returns a spanning forest of its links, so that a dense group of near copies gives
as many rows as it has values and not as many as it has pairs.

Nulls: a null text counts as empty. A null doc_id is kept and never becomes a component's id unless all of the
component's ids are null. Repeated rows give repeated rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_columns, small_batches, staged, table
from .components import connected_components

SEED, SHINGLE, BUDGET = 42, 3, 2
#: Most values in a leaf of a trie before it is cut deeper, by STEP bits at most; where there are few values, a LEAVES-th of them, but
#: not under LEAST_LEAF.
LEAF, LEAST_LEAF, LEAVES, STEP = 1 << 15, 1 << 12, 32, 6
#: Node pairs of at most so many value pairs are compared outright; frontiers are at most FRONT node pairs long.
SMALL, FRONT = 64, 1 << 18
#: Rows (two longs each) that are sent to every task; more are joined by a shuffle.
MOST_SENT = 1 << 19


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of all windows of ``shingle`` words, in their order."""
    return np.concatenate([np.empty(0, "<u8"), *_hashed(text, shingle)])


def _hashed(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        yield np.array([digest(joined, SEED)], "<u8")
        return
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: 1 - shingle].tolist()
    ends = ends[shingle - 1 :].tolist()
    for at in range(0, len(starts), 1 << 16):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(_hashed(text, shingle))


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the 64-bit hashes, which come in parts of a bounded size."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (which tells texts of one doc_id apart) and ``fp`` (the 64 bits as a signed long) of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter(map(fingerprint, b.column(1).to_pylist()), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], ["doc_id", "key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return clean_columns(docs, "doc_id", "text").withColumn("key", text_key()).mapInArrow(run, f"doc_id {kind}, key long, fp long")


def text_key() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of the links that aren't their component's least."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        new = new[lab]
        if np.array_equal(new, lab):
            break
        lab = new
    other = lab != np.arange(len(nodes))
    return nodes[other], nodes[lab[other]]


def trie_links(a: np.ndarray, depth: int, block: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within a sorted array of distinct values, as a spanning forest.

    ``depth``: how many leading bits all values share; ``block``: in how many two values must agree to be looked at.
    """
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    held = 0
    front = [(depth, np.array([[0, len(a), 0, len(a), 0, 1]], np.int64))]

    def fold() -> None:
        nonlocal held
        if us:
            x, y = spanning(np.concatenate(us), np.concatenate(vs))
            us[:], vs[:], held = [x], [y], len(x)

    while front:
        d, f = front.pop()
        if not len(f):
            continue
        if len(f) > FRONT:
            half = len(f) // 2
            front += [(d, f[half:]), (d, f[:half])]
            continue
        na, nb = f[:, 1] - f[:, 0], f[:, 3] - f[:, 2]
        flat = (na * nb <= SMALL) | (d >= 64)
        if flat.any():
            s = f[flat]
            for at in range(0, len(s), FRONT // 4):
                t = s[at : at + FRONT // 4]
                n = (t[:, 1] - t[:, 0]) * (t[:, 3] - t[:, 2])
                row = np.repeat(np.arange(len(t)), n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                wide = t[row, 3] - t[row, 2]
                i, j = t[row, 0] + k // wide, t[row, 2] + k % wide
                near = (_popcount(a[i] ^ a[j]) <= budget) & ~((t[row, 5] == 1) & (i >= j))
                if near.any():
                    us.append(a[i[near]])
                    vs.append(a[j[near]])
                    held += int(near.sum())
                if held > 1 << 21:
                    fold()
            f = f[~flat]
        if not len(f):
            continue
        bit = np.uint64(1) << np.uint64(63 - d)
        low = ~((bit << np.uint64(1)) - np.uint64(1)) if d else np.uint64(0)
        am = np.clip(np.searchsorted(a, (a[f[:, 0]] & low) | bit), f[:, 0], f[:, 1])
        bm = np.clip(np.searchsorted(a, (a[f[:, 2]] & low) | bit), f[:, 2], f[:, 3])
        one, alike = f[:, 4], f[:, 5]
        lo_a, hi_a, lo_b, hi_b = f[:, 0], f[:, 1], f[:, 2], f[:, 3]
        zero = np.zeros_like(one)
        kids = [
            np.column_stack([lo_a, am, lo_b, bm, one, alike]),
            np.column_stack([am, hi_a, bm, hi_b, one, alike]),
            np.column_stack([lo_a, am, bm, hi_b, one + 1, zero]),
            np.column_stack([am, hi_a, lo_b, bm, one + 1, zero])[alike == 0],
        ]
        nxt = np.concatenate(kids[:2] if d < block else kids)
        front.append((d + 1, nxt[(nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3]) & (nxt[:, 4] <= budget)]))
    fold()
    return (us[0], vs[0]) if us else (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _turned(rows: DataFrame, shared: int, budget: int) -> DataFrame:
    """``rows`` (``fp, turned, path``), each ``budget`` + 1 times: behind the ``shared`` leading bits, another block comes first."""
    rest = 64 - shared
    mask = F.lit((1 << rest) - 1 if shared else -1).cast("long")
    low, high = F.col("turned").bitwiseAND(mask), F.col("turned").bitwiseAND(F.bitwise_not(mask))

    def turn(k: int) -> F.Column:
        by = k * (rest // (budget + 1))
        bits = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, rest - by)).bitwiseAND(mask) if by else low
        return F.struct(high.bitwiseOR(bits).alias("turned"), F.concat("path", F.lit(f"{k}.")).alias("path"))

    return rows.select("fp", F.explode(F.array(*[turn(k) for k in range(budget + 1)])).alias("t")).select("fp", "t.turned", "t.path")


def trie_leaves(fps: DataFrame, n: int, budget: int, leaf: int = LEAF, step: int = STEP) -> DataFrame:
    """``fp, turned, path, prefix, depth, block``: the values of each leaf (``path, depth, prefix``), which share ``depth`` bits of
    ``turned``, and of these and more the ``block`` bits that count there."""
    active = _turned(fps.select("fp", F.col("fp").alias("turned"), F.lit("").alias("path")), 0, budget)
    block = 64 // (budget + 1)
    depth = min(block, max(1, int(np.ceil(np.log2(2 * max(1, n) / leaf)))))
    out, rounds = None, 0
    while True:
        at = active.withColumn("prefix", F.shiftrightunsigned("turned", 64 - depth))
        counts = at.groupBy("path", "prefix").agg(F.count("*").alias("n")).select("path", "prefix", "n", (F.col("n") > leaf).alias("cut"))
        counts = staged(counts, "trie-counts")
        most = counts.where("cut").agg(F.max("n")).first()[0]
        last = most is None or depth == block and 64 - depth <= budget  # distinct values that differ in so few bits are few
        marked = at if last else staged(at.join(counts.select("path", "prefix", "cut"), ["path", "prefix"]), "trie-values")
        done = marked if last else marked.where("not cut").select(*at.columns)
        done = done.select("*", F.lit(depth).alias("depth"), F.lit(block).alias("block"))
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        active, rounds = marked.where("cut").select("fp", "turned", "path"), rounds + 1
        if depth == block:
            active = _turned(active, depth, budget)
            block += (64 - depth) // (budget + 1)
        # As deep as the most crowded prefix needs if its values spread evenly; by more each time, so that there are few rounds.
        depth = min(block, depth + min(step, max(rounds, int(np.ceil(np.log2(most / leaf))))))


def trie_join(fps: DataFrame, budget: int = BUDGET, leaf: int | None = None) -> DataFrame:
    """Links ``u``, ``v`` between the distinct values ``fp`` of which at most ``budget`` bits differ: a spanning forest for each leaf."""
    n = fps.count()
    leaves = trie_leaves(fps, n, budget, leaf or min(LEAF, max(LEAST_LEAF, n // LEAVES)))

    def run(t: pa.Table) -> pa.Table:
        fp, turned = (t.column(x).to_numpy().astype(np.int64, copy=False) for x in ("fp", "turned"))
        turned = turned.view(np.uint64)
        order = np.argsort(turned)
        fp, turned = fp[order], turned[order]
        links = trie_links(turned, t.column("depth")[0].as_py(), t.column("block")[0].as_py(), budget)
        u, v = (fp[np.searchsorted(turned, x)] for x in links)
        return pa.table({"u": u, "v": v})

    return leaves.groupBy("path", "depth", "prefix").applyInArrow(run, "u long, v long")


def _grouped(rows: DataFrame, budget: int, leaf: int | None) -> DataFrame:
    """``fp``, the ``root`` of its component and the ``least`` doc_id of its rows."""
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(trie_join(classes.select("fp"), budget, leaf))
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left")
    return placed.select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, budget: int = BUDGET, leaf: int | None = None) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the least doc_id that links reach) of each row."""
    rows = staged(fingerprints(docs).select("doc_id", "fp"), "simhash")
    placed = staged(_grouped(rows, budget, leaf), "simhash-roots")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, budget: int = BUDGET, leaf: int | None = None) -> DataFrame:
    """``docs`` without the documents that have an earlier one, by (doc_id, text), in their component.

    Rows that agree in doc_id and text are one document. All columns are kept.
    """
    rows = staged(fingerprints(docs), "simhash")
    placed = staged(_grouped(rows, budget, leaf).select("fp", "root"), "simhash-roots")
    return first_of_each(docs, staged(rows.join(placed, "fp").select("doc_id", "key", "root"), "simhash-rows"))


def first_of_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """``docs`` without those that aren't the first of their group. ``rooted`` (staged): ``doc_id, key, root`` of each row."""
    place = F.struct("doc_id", "key")
    first = rooted.groupBy("root").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    gone = rooted.join(first, "root").where(~place.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    gone = staged(gone, "simhash-gone")
    gone = F.broadcast(gone) if gone.count() <= MOST_SENT else gone
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (text_key() == F.col("__key")), "left_anti")


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
