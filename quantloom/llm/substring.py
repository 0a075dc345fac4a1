"""Substring dedup by sliding sentence spans.

A text is cut into sentences, lossless: each ends with its ``. ! ?`` or line breaks and the white space after them.
A sentence of over LONG words is cut further after ``, ; :``, and what is still longer after words whose hash says
so, which puts the cuts at the same words wherever a passage stands. From each sentence on, the fewest (at least
two) consecutive sentences that reach MIN_WORDS words form a span. A span is identified by a 64-bit hash of its
words, A-Z lower-cased, white space ignored. Spans are joined over the whole corpus; the first occurrence of a hash,
by (doc_id, text, position), stays, and every sentence that any other occurrence covers is removed.

Only hashes that occur again meet the spans a second time, and that side has one row for each hash, so a passage
which a third of all documents share skews one join's probe side only, which adaptive execution splits.

Nulls: a null text counts as empty and stays null. A null doc_id ranks before the others. Rows that agree in doc_id
and text are one document and get the same result, once for each row. Texts of fewer than two sentences or than
MIN_WORDS words are returned as they are. No row is dropped: a text may become empty. Other columns are kept by
``remove_repeats``; columns it works with have names of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_columns, small_batches, staged, table

MIN_WORDS, MIN_SENTENCES, LONG = 16, 2, 24
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*\s*|[.!?\n]+\s*")
CLAUSE = re.compile(r"[^,;:]+[,;:]*\s*|[,;:]+\s*")
WORD = re.compile(r"\s*\S+\s*|\s+")


def sentences(text: str) -> tuple[list[str], list[list[bytes]]]:
    """The sentences, which together are the text, and the words of each."""
    parts, words = [], []
    for s in SENTENCE.findall(text):
        w = s.encode("utf-8", "surrogatepass").lower().split()
        if len(w) <= LONG:
            parts.append(s)
            words.append(w)
            continue
        for c in CLAUSE.findall(s):
            w = c.encode("utf-8", "surrogatepass").lower().split()
            if len(w) <= LONG:
                parts.append(c)
                words.append(w)
                continue
            held: list[str] = []
            for x in WORD.findall(c):
                held.append(x)
                if xxhash.xxh32_intdigest(x.strip().lower()) % 8 == 0:
                    parts.append("".join(held))
                    held = []
            if held:
                parts.append("".join(held))
            words += [p.encode("utf-8", "surrogatepass").lower().split() for p in parts[len(words) :]]
    return parts, words


def spans(words: list[list[bytes]], min_words: int = MIN_WORDS, least: int = MIN_SENTENCES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (past it) and hash of each span."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, n))])
    start = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + min_words), start + least)
    fits = (end <= n) & (total[1:] > total[:-1])
    start, end = start[fits], end[fits]
    if not len(start):
        return start, end, start
    # The hash of a span is that of its words' bytes; where its sentences end doesn't matter.
    joined = b" ".join([b" ".join(w) for w in words if w])
    size = np.fromiter((sum(map(len, w)) + len(w) for w in words), np.int64, n)
    at = np.concatenate([[0], np.cumsum(size)])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b]) for a, b in zip(at[start].tolist(), (at[end] - 1).tolist())], np.uint64)
    return start, end, h.view(np.int64)


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def corpus_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``h, doc_id, key, at``: a row for each span that starts at sentence ``at``. ``key`` tells texts of one doc_id apart."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, hs = [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                start, _, h = spans(sentences(t or "")[1], min_words)
                if len(h):
                    row.append(np.full(len(h), k))
                    at.append(start)
                    hs.append(h)
            if row:
                take = pa.array(np.concatenate(row))
                cols = [pa.array(np.concatenate(hs)), b.column("doc_id").take(take), b.column("key").take(take), pa.array(np.concatenate(at).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["h", "doc_id", "key", "at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = clean_columns(docs, "doc_id", "text").withColumn("key", _key(F.col("text")))
    return rows.mapInArrow(run, f"h long, doc_id {kind}, key long, at int")


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, key, starts, firsts``: where the spans start that repeat an earlier one, and the doc_ids that hold their first occurrences."""
    all_spans = staged(corpus_spans(docs, min_words), "spans")
    place = F.struct("doc_id", "key", "at")
    again = all_spans.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    hits = all_spans.join(again.select("h", "first"), "h").where(~place.eqNullSafe(F.col("first")))
    # A document has one row for each of its sentences at most.
    return hits.groupBy("doc_id", "key").agg(F.collect_set("at").alias("starts"), F.collect_set("first.doc_id").alias("firsts"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated sentences gone from ``text``; ``__removed``: ``n_sentences`` and ``spans`` (character offsets in the old text); and ``__firsts``."""
    marks = repeated(docs, min_words).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("starts").alias("__starts"), F.array_sort("firsts").alias("__firsts"))
    keyed = docs.withColumn("__text_key", _key(F.col("text")))
    joined = keyed.join(marks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left")
    joined = joined.drop("__id", "__key", "__text_key")
    names = docs.columns
    out = "__removed struct<n_sentences: long, spans: array<struct<begin: long, end: long>>>"
    kind = pa.struct([("n_sentences", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])

    def cut(text: str | None, starts: list[int] | None) -> tuple[str | None, dict]:
        parts, words = sentences(text or "")
        found = {"n_sentences": len(parts), "spans": []}
        if not starts:
            return text, found
        begin, end, _ = spans(words, min_words)
        ends = dict(zip(begin.tolist(), end.tolist()))
        gone = np.zeros(len(parts) + 1, np.int64)
        for s in starts:
            gone[s] += 1
            gone[ends[s]] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        offset = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        found["spans"] = [{"begin": int(offset[a]), "end": int(offset[b])} for a, b in zip(edge[::2], edge[1::2])]
        return "".join([p for p, g in zip(parts, gone) if not g]), found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [cut(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("__starts").to_pylist())]
            text = pa.array([x for x, _ in rows], b.schema.field("text").type)
            cols = [text if n == "text" else b.column(n) for n in names] + [pa.array([x for _, x in rows], kind), b.column("__firsts")]
            yield pa.RecordBatch.from_arrays(cols, [*names, "__removed", "__firsts"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    ids = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"{fields}, {out}, __firsts array<{ids}>")


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(clean_columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", "text", F.col("__removed.n_sentences").alias("n_sentences"), F.col("__removed.spans").alias("removed"), F.coalesce("__firsts", F.array().cast("array<bigint>")).alias("repeats_of"))
