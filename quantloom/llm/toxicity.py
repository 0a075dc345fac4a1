"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows around each hit.

Lexicon. In the learning rows, each distinct text counts once for its distinct words and for their stems (prefixes of
four to six letters). A term enters if the lower end of its log odds of standing in a toxic text, as a 95 % interval
has it, is at least LEAST_ODDS, and it stands in LEAST_TEXTS toxic texts and in LEAST_SHARE of them, whatever the size of the
corpus (rarer ones are mostly words that near copies of one text share); terms that a better one covers are dropped: words with a stem that is in, and stems most of whose texts have one word or longer stem. Half of the learning rows find the terms, the other half calibrates, so a term that
only happens to stand in toxic texts is seen to fail.

Matching. The terms form a trie. A word is looked up by walking the trie with the word's Levenshtein automaton: a set
of (position, errors) states, bit-packed, one word of bits for each number of errors; a branch whose set is empty is
left. Words of at least five letters may be one edit away, of at least nine two. An automaton is only run for words
that begin or end like a part of a term that k edits cannot all have touched. Results are kept for each distinct word.

Context. Each hit looks at the words around it: quotation marks at words' edges (so no contraction's apostrophe) and verbs
of reporting lessen it, words of address raise it. A logistic regression over the sums by kind of hit gives the score.

Bounds. Terms are learned from a sample of about LEARN_ROWS labelled rows, the regression from one of about FIT_ROWS, both
chosen by a hash of doc_id; with fewer labelled rows, from all. Nothing else is bounded.

Labels come from ``labels`` rows whose crc32(doc_id as text) mod 5 isn't 0; labels, lang, source and doc_id are no
inputs of a score. Nulls: a null text counts as empty, which scores what no hit scores. Rows without a doc_id or
label aren't learned from; several labels of one id count as toxic if one is. Repeated rows are scored as often as
they stand; other columns are ignored; without any label of either kind every score is 0. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_columns, small_batches, staged, table

STEMS, HELD, CACHE = (4, 5, 6), 500_000, 400_000
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS, COVERED, LEARN_ROWS, FIT_ROWS = 4, 0.02, 1.5, 0.8, 200_000, 20_000
WINDOW = 5
EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»„“”‘’‹›¡¿…–—"
QUOTES = set("\"'«»„“”‘’‹›")
REPORTING = set("said says wrote writes quoted called calls stated claims claimed dit disait écrit sagte sagt schrieb nannte dijo dice escribió llamó".split())
ADDRESS = set("you your you're u ur yourself tu te toi vous votre ton ta du dich dir dein deine ihr euch usted tú tus eres".split())
WORD, STEM, NEAR_WORD, NEAR_STEM = range(4)
FEATURES = 8


def edits(length: int) -> int:
    return 2 if length >= 9 else 1 if length >= 5 else 0


class Trie:
    """Terms and how they match. ``terms``: (term, is a stem, weight)."""

    def __init__(self, terms: list[tuple[str, bool, float]]) -> None:
        self.root: dict = {}
        self.exact: dict[str, float] = {}
        self.stem: dict[str, float] = {}
        self.parts: set[tuple[int, str, bool]] = set()
        self.stem_parts: set[str] = set()
        for term, is_stem, weight in terms:
            (self.stem if is_stem else self.exact)[term] = weight
            k = edits(len(term))
            if not k:
                continue
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((is_stem, weight, k))
            # Of k + 1 parts, k edits leave one whole. Its place in the word moves by at most k.
            cuts = [len(term) * i // (k + 1) for i in range(k + 2)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                for shift in range(-k, k + 1) if i else (0,):
                    self.parts.add((a + shift, term[a:b], is_stem))
        self.probes = sorted({(a, len(p)) for a, p, _ in self.parts if a >= 0})
        self.words_at = {(a, p) for a, p, s in self.parts}
        self.longest = max((len(t) for t, _, _ in terms), default=0)
        self.stems_by = sorted({len(t) for t in self.stem}, reverse=True)
        self.cache: dict[str, tuple[int, float] | None] = {}

    def walk(self, word: str) -> tuple[int, float] | None:
        """The best near term of ``word``: the trie walked with the word's Levenshtein automaton."""
        n, full = len(word), (1 << (len(word) + 1)) - 1
        mask: dict[str, int] = {}
        for i, c in enumerate(word):
            mask[c] = mask.get(c, 0) | (1 << i)
        most = 2
        # rows[e]: bit i is set if i letters of the word can be used up with e edits.
        start = [(1 << (e + 1)) - 1 & full for e in range(most + 1)]
        best: tuple[int, float] | None = None
        stack = [(self.root, start)]
        while stack:
            node, rows = stack.pop()
            for is_stem, weight, k in node.get("", ()):
                # A word must be used up; of a stem, any number of letters will do.
                if any((rows[e] if is_stem else rows[e] >> n & 1) for e in range(k + 1)) and (best is None or weight > best[1]):
                    best = (NEAR_STEM if is_stem else NEAR_WORD, weight)
            for c, child in node.items():
                if not c:
                    continue
                m, new = mask.get(c, 0), []
                for e in range(most + 1):
                    r = (rows[e] & m) << 1
                    if e:
                        r |= rows[e - 1] | (rows[e - 1] << 1) | (new[e - 1] << 1)  # a term's letter more, another letter, a word's letter more
                    new.append(r & full)
                if new[-1]:
                    stack.append((child, new))
        return best

    def match(self, word: str) -> tuple[int, float] | None:
        """Kind and weight of a word's match, or None. The word has no punctuation at its edges."""
        w = self.exact.get(word)
        if w is not None:
            return WORD, w
        for n in self.stems_by:
            if len(word) >= n and (w := self.stem.get(word[:n])) is not None:
                return STEM, w
        if len(word) < 4:
            return None
        at = self.words_at
        for a, n in self.probes:
            if (a, word[a : a + n]) in at:
                return self.walk(word)
        return None

    def lookup(self, token: str) -> tuple[int, float] | None:
        got = self.match(token.strip(EDGE))
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[token] = got
        return got


def edge_quotes(word: str) -> tuple[int, int]:
    """Quotation marks before a word's first and after its last letter or digit."""
    bare = word.strip(EDGE)
    if not bare:
        return sum(c in QUOTES for c in word), 0
    at = word.index(bare)
    return sum(c in QUOTES for c in word[:at]), sum(c in QUOTES for c in word[at + len(bare) :])


def features(text: str, trie: Trie) -> np.ndarray:
    out = np.zeros(FEATURES)
    words = text.lower().split()
    get, look = trie.cache.get, trie.lookup
    hits = [(i, m) for i, w in enumerate(words) if (m := get(w, 0) if w in trie.cache else look(w))]
    if not hits:
        return out
    sums, most, quoted = np.zeros(4), 0.0, 0.0
    for i, (kind, weight) in hits:
        around = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        bare = {w.strip(EDGE) for w in around}
        opened, closed = edge_quotes(words[i])
        before = opened + sum(sum(edge_quotes(w)) for w in words[max(0, i - WINDOW) : i])
        quote = 0.5 * bool(opened or closed or before % 2) + 0.3 * bool(bare & REPORTING)
        near = weight * (1 - quote) * (1.25 if bare & ADDRESS else 1.0)
        sums[kind] += near
        quoted += quote
        most = max(most, near if kind <= STEM else near / 2)
    out[:4] = np.log1p(np.maximum(sums, 0))
    out[4:] = most, quoted / len(hits), 100 * len(hits) / len(words), math.log1p(len(hits))
    return out


def _bucket() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def _sampled(rows: DataFrame, most: int, salt: str) -> DataFrame:
    """About ``most`` of the rows, chosen by a hash of doc_id, or all if there are no more."""
    n = rows.count()
    return rows if n <= most else rows.where(F.crc32(F.concat(F.lit(salt), F.col("doc_id").cast("string"))) < int(most / n * (1 << 32)))


def learning_rows(docs: DataFrame, labels: DataFrame, most: int = LEARN_ROWS) -> DataFrame:
    """``doc_id, text, toxic, bucket`` of the labelled rows that are learned from."""
    rows = clean_columns(labels, "doc_id", "toxic").where("toxic is not null").where(_bucket() != 0)
    rows = staged(rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "toxic-labels")
    rows = F.broadcast(_sampled(rows, most, "learn"))
    t = clean_columns(docs, "doc_id", "text").where("text is not null").where(_bucket() != 0).join(rows, "doc_id")
    return t.withColumn("bucket", _bucket())


def term_counts(rows: DataFrame) -> DataFrame:
    """``term, stem, toxic, clean``: in how many texts of either kind a term stands."""
    small_batches(rows.sparkSession)
    schema = pa.schema([("term", pa.string()), ("stem", pa.bool_()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        strip: dict[str, str] = {}

        def out() -> pa.RecordBatch:
            keys = list(counts)
            cols = [pa.array([k[1:] for k in keys]), pa.array([k[0] == "s" for k in keys]), pa.array([counts[k][1] for k in keys], pa.int64()), pa.array([counts[k][0] for k in keys], pa.int64())]
            counts.clear()
            strip.clear()
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = set()
                for w in set(text.lower().split()):
                    s = strip.get(w)
                    if s is None:
                        s = strip[w] = w.strip(EDGE)
                    words.add(s)
                terms = {"w" + w for w in words if w}
                for n in STEMS:
                    terms.update(["s" + w[:n] for w in words if len(w) > n])
                for t in terms:
                    c = counts.get(t)
                    if c is None:
                        c = counts[t] = [0, 0]
                    c[toxic] += 1
            if len(counts) >= HELD:
                yield out()
        if counts:
            yield out()

    once = rows.groupBy(F.xxhash64("text").alias("same"), F.sha2("text", 256).alias("sha")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    found = once.select("text", F.when(F.col("toxic") != 0, 1).otherwise(0).alias("toxic")).mapInArrow(run, "term string, stem boolean, toxic long, clean long")
    return found.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(rows: DataFrame, least: float = LEAST_ODDS) -> list[tuple[str, bool, float]]:
    """The terms with their weights. ``rows``: ``text, toxic``."""
    totals = {bool(r.t): r.n for r in rows.groupBy((F.col("toxic") != 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return []
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / (totals[True] + 1)) - F.log(c / (totals[False] + 1))
    sure = odds - 1.96 * F.sqrt(1 / t + 1 / c)
    best = term_counts(rows).where(F.col("toxic") >= max(LEAST_TEXTS, LEAST_SHARE * totals[True])).withColumn("sure", sure).where(F.col("sure") >= least).collect()
    stems: set[str] = set()
    most: dict[str, int] = {}  # by prefix of STEMS letters: texts of the commonest kept term that begins so
    kept = []
    # Of equals, words come before stems, and longer stems before shorter ones.
    for r in sorted(best, key=lambda r: (-r.sure, r.stem, -len(r.term), r.term)):
        if any(r.term[:n] in stems for n in STEMS) or (r.stem and most.get(r.term, 0) >= COVERED * r.toxic):
            continue
        if r.stem:
            stems.add(r.term)
        for n in STEMS:
            if len(r.term) >= n:
                most[r.term[:n]] = max(most.get(r.term[:n], 0), r.toxic)
        kept.append((r.term, r.stem, float(r.sure)))
    return kept


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: centre, scale and coefficients (the last is the constant)."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    beta = np.zeros(z.shape[1])
    keep = np.full(z.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, sd, beta


def probability(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(x))
    mean, sd, beta = model
    return 1 / (1 + np.exp(-np.clip((x - mean) / sd @ beta[:-1] + beta[-1], -30, 30)))


def _rows_of(column: pa.Array, trie: Trie) -> np.ndarray:
    return np.array([features(t or "", trie) for t in column.to_pylist()]).reshape(-1, FEATURES)


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, bool, float]], tuple | None]:
    rows = learning_rows(docs, labels)
    terms = learn_lexicon(rows.where("bucket <= 2"))
    held = _sampled(rows.where("bucket > 2").select("doc_id", "text", "toxic"), FIT_ROWS, "fit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(terms)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_rows_of(b.column("text"), trie)), pa.list_(pa.float64())), b.column("toxic")], ["x", "toxic"])

    small_batches(docs.sparkSession)
    got = held.mapInArrow(run, "x array<double>, toxic int").collect()
    y = np.array([r.toxic != 0 for r in got], float)
    return terms, fit(np.array([r.x for r in got]), y) if 0 < y.sum() < len(y) else None


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``__score``, the probability that a text is toxic."""
    terms, model = learn(docs, labels)
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(terms)
        for b in batches:
            p = probability(_rows_of(b.column("text"), trie), model)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(p, pa.float64())], [*names, "__score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, __score double")


def op7_lexicon_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clean_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = scored(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(_bucket() == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
