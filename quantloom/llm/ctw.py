"""LM scoring by context-tree weighting over bytes.

Model. A byte is eight binary decisions, most significant bit first; each decision (one of 255 nodes, by the bits
before it) has a context tree of its own over the DEPTH bytes before. A node of that tree estimates its bit by
Krichevsky-Trofimov, (n_bit + 1/2) / (n + 1), and weighs that estimate against its children's: P_w = 1/2 P_kt +
1/2 prod P_w(child), P_w = P_kt at DEPTH. Scoring uses the trained tree as it stands: at each node on the context's
path the estimate counts with its posterior weight 1/2 P_kt / P_w, the rest goes deeper, so all depths mix. The code
length of a text is the sum over its lower-cased bytes and one zero byte at its end; DEPTH zero bytes stand before it.

Scale. The corpus is reduced to counts of (context, byte) grams and of tokens, combined in each task before the
shuffle. The tree is cut into subtrees by the two newest context bytes; each is weighed by one task, and only sums
for contexts of at most one byte (at most 256 * 255 rows) come together. Texts are dealt into blocks by a hash; a
block asks for the probabilities of its distinct grams and the counts of its distinct tokens by one join, and is
scored where the answers and its texts meet. No table of the model is ever sent whole, however large it grows.

Nulls: a null text counts as empty and scores its end alone. A null doc_id has no hash, so it is training data and
not held out. Repeated rows count and are returned as often as they stand. Other columns are ignored. Without any
training text the bits have probability 1/2. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_columns, drop_stage, give_back, small_batches, staged, table

DEPTH = 5
#: Bytes of text in a block; grams that a task sorts at once; distinct grams and tokens that a counting task holds.
BLOCK, GRAMS, HELD = 16 << 20, 3 << 20, 1_200_000
#: The end of a text as a token; no word is empty.
END = ""


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma, for x > 0, by Stirling's series above 10."""
    x = np.array(x, np.float64)
    shift = np.zeros_like(x)
    low = np.flatnonzero(x < 10)
    while len(low):
        shift[low] -= np.log(x[low])
        x[low] += 1
        low = low[x[low] < 10]
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the KT probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1) - math.log(math.pi)


def grams(text: bytes, depth: int = DEPTH) -> np.ndarray:
    """For each byte of the text and its end: the ``depth`` bytes before it and the byte, as one integer."""
    a = np.frombuffer(b"\0" * depth + text + b"\0", np.uint8).astype(np.int64)
    n = len(text) + 1
    code = np.zeros(n, np.int64)
    for k in range(depth + 1):
        code = (code << 8) | a[k : k + n]
    return code


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased; nulls become empty."""
    return pc.ascii_lower(pc.fill_null(texts, ""))


def words_of(low: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the row of each."""
    parts = pc.ascii_split_whitespace(low)
    flat = parts.flatten()
    row = np.repeat(np.arange(len(low), dtype=np.int32), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    full = pc.not_equal(flat, "")
    return flat.filter(full), row[full.to_numpy(zero_copy_only=False)]


def tally(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their counts."""
    keys, at = np.unique(codes, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


class Lookup:
    """Values by non-negative integer key, all of which it holds: tables whose losers go to the next table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.tables: list[tuple[np.ndarray, np.uint64, np.uint64]] = []
        odd = 0x9E3779B97F4A7C15
        while len(keys):
            bits = max(4, int(2 * len(keys)).bit_length())
            table = np.full((1 << bits, 2), -1, np.int64)
            factor, shift = np.uint64(odd), np.uint64(64 - bits)
            at = (keys.astype(np.uint64) * factor) >> shift
            table[at] = np.column_stack([keys, values.view(np.int64)])
            lost = table[at, 0] != keys
            self.tables.append((table, factor, shift))
            keys, values = keys[lost], values[lost]
            odd = (odd * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, left = None, None
        for table, factor, shift in self.tables:
            got = table[(keys.astype(np.uint64) * factor) >> shift]
            miss = np.flatnonzero(got[:, 0] != keys)
            if out is None:
                out, left = got[:, 1].copy(), miss
            else:
                out[left] = got[:, 1]
                left = left[miss]
            keys = keys[miss]
            if not len(keys):
                break
        if out is None or len(keys):
            raise KeyError("a key is missing")
        return out.view(np.float64)


class Subtree:
    """The weighted trees of all contexts that end with the same ``top`` bytes. ``codes``: distinct grams; ``counts``: theirs.

    ``levels``: for depth ``depth`` down to ``top``, the sorted (context, byte) pairs of that depth. In this order the
    pairs of any node of a context stand together, so that nodes are runs.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, top: int, depth: int = DEPTH) -> None:
        self.byte = codes & 255
        at = None
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        keys, n = codes, counts.astype(np.float64)
        for d in range(depth, top - 1, -1):
            own = (((keys >> 8) & ((1 << (8 * d)) - 1)) << 8) | (keys & 255)
            keys_up, up = np.unique(own, return_inverse=True)
            n = np.bincount(up, n, len(keys_up))
            at = up if at is None else up[at]
            self.levels.append((keys_up, n, up, at))
            keys = keys_up
        self.steps = []
        for bit in range(8):
            deeper, found = None, []
            for k, (keys, n, up, _) in enumerate(self.levels):
                node = (keys >> 8 << 8) | (1 << bit) | ((keys & 255) >> (8 - bit))
                run = np.concatenate([[0], np.cumsum(node[1:] != node[:-1])])
                first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                n1 = np.add.reduceat(n * ((keys >> (7 - bit)) & 1), first)
                n0 = np.add.reduceat(n, first) - n1
                kt = log_kt(n0, n1)
                if deeper is None:
                    weighted, weight = kt, np.ones(len(kt))
                else:
                    # A node of the level below belongs to the run of its first pair.
                    start, lw = deeper
                    below = np.bincount(run[up[start]], lw, len(kt))
                    weighted = np.logaddexp(kt, below) - math.log(2)
                    weight = np.exp(kt - math.log(2) - weighted)
                found.append((run, n0, n1, weight))
                deeper = first, weighted
            first, weighted = deeper
            self.steps.append((found, 1 << bit | ((self.levels[-1][0][first] & 255) >> (8 - bit)), weighted))

    def roots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Node, log weighted probability and counts of each node at depth ``top``."""
        parts = [(node, lw, found[-1][1], found[-1][2]) for found, node, lw in self.steps]
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))

    def bits(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit, the node, the bit and its probability under the subtree, of each gram."""
        for bit, (found, _, _) in enumerate(self.steps):
            b = (self.byte >> (7 - bit)) & 1
            p = None
            for (run, n0, n1, weight), (_, _, _, at) in zip(found, self.levels):
                own = run[at]
                q = (np.where(b == 0, n0[own], n1[own]) + 0.5) / (n0[own] + n1[own] + 1)
                p = q if p is None else weight[own] * q + (1 - weight[own]) * p
            yield (1 << bit) | (self.byte >> (8 - bit)), b, p


def combine(nodes: np.ndarray, lw: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, ...]:
    """The parent of several subtrees, by node (an array of 256 each): log weighted probability, counts and weight."""
    m0, m1, below = (np.bincount(nodes, x, 256) for x in (n0, n1, lw))
    kt = log_kt(m0, m1)
    weighted = np.logaddexp(kt, below) - math.log(2)
    return weighted, m0, m1, np.exp(kt - math.log(2) - weighted)


def _train() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))


def corpus_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``gram`` or ``token`` with its ``count`` in training texts, combined in each task. Others come with count 0.

    A row with neither has in ``count`` the bytes of all texts that a task read.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("gram", pa.int64()), ("token", pa.string()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose: dict[bool, list[np.ndarray]] = {True: [], False: []}
        packed: list[tuple[np.ndarray, np.ndarray]] = []
        tokens: list[pa.Table] = []
        size = read = held = 0

        def pack() -> None:
            """Sorts the loose grams; joins packed ones."""
            for train in (True, False):
                if loose[train]:
                    codes, counts = np.unique(np.concatenate(loose[train]), return_counts=True)
                    packed.append((codes, counts if train else np.zeros(len(codes), np.int64)))
                    loose[train] = []
            if packed:
                packed[:] = [tally(np.concatenate([c for c, _ in packed]), np.concatenate([n for _, n in packed]))]

        def join() -> None:
            if tokens:
                tokens[:] = [pa.concat_tables(tokens).group_by("token").aggregate([("count", "sum")]).rename_columns(["token", "count"])]

        def out() -> Iterator[pa.RecordBatch]:
            for codes, counts in packed:
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.nulls(len(codes), pa.string()), pa.array(counts)], schema=schema)
            for t in tokens:
                for b in t.combine_chunks().to_batches():
                    yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column("token"), b.column("count")], schema=schema)
            packed.clear()
            tokens.clear()
            give_back()

        for batch in batches:
            low = lowered(batch.column("text"))
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for t, learn in zip(low.cast(pa.binary()).to_pylist(), train.tolist()):
                loose[learn].append(grams(t, depth))
                size += len(t) + 1
                read += len(t)
            words, row = words_of(low)
            for learn in (True, False):
                found = pc.value_counts(words.filter(pa.array(train[row] == learn)))
                count = found.field("counts").to_numpy()
                texts = int((train == learn).sum())
                names = pa.concat_arrays([found.field("values"), pa.array([END], pa.string())])
                tokens.append(pa.table({"token": names, "count": np.append(count, texts) if learn else np.zeros(len(count) + 1, np.int64)}))
                held += len(names)
            if size >= GRAMS:
                pack()
                size = 0
            if held >= HELD // 2:
                join()
                held = sum(map(len, tokens))
                if held >= HELD // 4 or len(packed) and len(packed[0][0]) >= HELD:
                    yield from out()
                    held = 0
        pack()
        join()
        yield from out()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([read], pa.int64())], schema=schema)

    rows = clean_columns(docs, "doc_id", "text").select("text", _train().alias("train"))
    return rows.mapInArrow(run, "gram long, token string, count long")


def gram_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``gram`` and ``logp``, the log10 probability of its byte in its context, for each row of ``gram, count``."""
    spark = counts.sparkSession
    cut = counts.select("gram", "count", F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("s2"))

    def up(t: pa.Table) -> pa.Table:
        s2 = t.column("s2")[0].as_py()
        node, lw, n0, n1 = Subtree(t.column("gram").to_numpy(), t.column("count").to_numpy(), 2, depth).roots()
        return pa.table({"s1": np.full(len(node), s2 & 255, np.int32), "node": node.astype(np.int32), "lw": lw, "n0": n0, "n1": n1})

    def mid(t: pa.Table) -> pa.Table:
        lw, n0, n1, weight = combine(*(t.column(c).to_numpy() for c in ("node", "lw", "n0", "n1")))
        seen = np.unique(t.column("node").to_numpy())
        return pa.table({"s1": np.full(len(seen), t.column("s1")[0].as_py(), np.int32), "node": seen.astype(np.int32), "lw": lw[seen], "n0": n0[seen], "n1": n1[seen], "weight": weight[seen]})

    small_batches(spark, 20_000)
    twos = cut.groupBy("s2").applyInArrow(up, "s1 int, node int, lw double, n0 double, n1 double")
    # Contexts of one byte: at most 256 of them with 255 nodes each, whatever the corpus.
    ones = twos.groupBy("s1").applyInArrow(mid, "s1 int, node int, lw double, n0 double, n1 double, weight double").toPandas()
    first = {s: (np.zeros(256), np.zeros(256), np.zeros(256)) for s in ones.s1.unique()}
    for s, own in ones.groupby("s1"):
        for a, c in zip(first[s], ("n0", "n1", "weight")):
            a[own.node] = own[c]
    _, r0, r1, r_weight = combine(*(ones[c].to_numpy() for c in ("node", "lw", "n0", "n1")))

    def down(t: pa.Table) -> pa.Table:
        code = t.column("gram").to_numpy()
        n0, n1, weight = first[t.column("s2")[0].as_py() & 255]
        logp = np.zeros(len(code))
        for node, b, p in Subtree(code, t.column("count").to_numpy(), 2, depth).bits():
            for a0, a1, w in ((n0, n1, weight), (r0, r1, r_weight)):
                q = (np.where(b == 0, a0[node], a1[node]) + 0.5) / (a0[node] + a1[node] + 1)
                p = w[node] * q + (1 - w[node]) * p
            logp += np.log10(p)
        return pa.table({"gram": code, "logp": logp})

    return cut.groupBy("s2").applyInArrow(down, "gram long, logp double")


def score(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of each row."""
    counts = staged(corpus_counts(docs, depth), "ctw-counts")
    gram_counts = staged(counts.where("gram is not null").groupBy("gram").agg(F.sum("count").alias("count")), "ctw-grams")
    token_counts = staged(counts.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")), "ctw-tokens")
    size = counts.where("gram is null and token is null").agg(F.sum("count")).first()[0] or 0
    n, v = token_counts.where("count > 0").agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    drop_stage(counts)
    logs = staged(gram_scores(gram_counts, depth), "ctw-scores")
    drop_stage(gram_counts)
    blocks = max(1, -(-size // block_bytes))
    rows = clean_columns(docs, "doc_id", "text").withColumn("train", _train())
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    dealt = rows.repartition(blocks, "block")

    def grams_wanted(t: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        loose: list[np.ndarray] = []
        size = 0
        for b in t.to_batches():
            for text in lowered(b.column("text")).cast(pa.binary()).to_pylist():
                loose.append(grams(text, depth))
                size += len(text) + 1
                if size >= GRAMS:
                    found.append(np.unique(np.concatenate(loose)))
                    loose, size = [], 0
        codes = np.unique(np.concatenate(found + loose))
        del found, loose
        give_back()
        return pa.table({"block": np.full(len(codes), t.column("block")[0].as_py(), np.int32), "gram": codes})

    def tokens_wanted(t: pa.Table) -> pa.Table:
        found = [pc.unique(words_of(lowered(b.column("text")))[0]) for b in t.to_batches()]
        own = pc.unique(pa.concat_arrays([*found, pa.array([END], pa.string())]))
        del found
        give_back()
        return pa.table({"block": np.full(len(own), t.column("block")[0].as_py(), np.int32), "token": own})

    blocked = dealt.groupBy("block")
    known = blocked.applyInArrow(grams_wanted, "block int, gram long").join(logs, "gram").select("block", "gram", F.lit(None).cast("string").alias("token"), F.col("logp").alias("x"))
    told = blocked.applyInArrow(tokens_wanted, "block int, token string").join(token_counts, "token").select("block", F.lit(None).cast("long").alias("gram"), "token", F.col("count").cast("double").alias("x"))
    unseen = math.log10(n + v + 1)

    def meet(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        own = answers.filter(pc.is_valid(answers.column("gram")))
        look = Lookup(own.column("gram").to_numpy(), own.column("x").to_numpy())
        own = answers.filter(pc.is_valid(answers.column("token")))
        names = own.column("token").combine_chunks()
        count = own.column("x").to_numpy()
        del own, answers
        gain = np.log10(count + 1)
        at_end = pc.index(names, END).as_py()
        end_count, end_gain = count[at_end], gain[at_end]
        low = lowered(texts.column("text").combine_chunks())
        rows = texts.num_rows
        tokens, size, hits = (np.zeros(rows, np.int64) for _ in range(3))
        base, sums = np.zeros(rows), np.zeros(rows)
        # The token table is hashed anew for each slice of texts, the gram table only once.
        for first in range(0, rows, 2000):
            words, row = words_of(low.slice(first, 2000))
            at = pc.index_in(words, value_set=names).to_numpy(zero_copy_only=False)
            k = min(2000, rows - first)
            tokens[first : first + k] = np.bincount(row, minlength=k) + 1
            hits[first : first + k] = np.bincount(row, count[at] > 0, k).astype(np.int64) + (end_count > 0)
            base[first : first + k] = np.bincount(row, gain[at], k) + end_gain
        base -= tokens * unseen
        for first in range(0, rows, 200):
            codes = [grams(t, depth) for t in low.slice(first, 200).cast(pa.binary()).to_pylist()]
            own = np.array([len(c) for c in codes])
            size[first : first + 200] = own
            sums[first : first + 200] = np.add.reduceat(look(np.concatenate(codes)), np.cumsum(own) - own)
        held_out = pc.invert(texts.column("train").combine_chunks())
        cols = [texts.column("doc_id").combine_chunks(), held_out, tokens, hits, np.full(rows, n, np.int64), base, sums, -sums * math.log2(10) / size]
        done = pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=out)
        del look, names, low, texts
        give_back()
        return done

    out = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    # A group is one block of texts and its answers, so its batches may be long.
    small_batches(docs.sparkSession, 20_000)
    return blocked.cogroup(known.unionByName(told).groupBy("block")).applyInArrow(meet, kinds)


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
