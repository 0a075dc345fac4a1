"""Packing by concatenate and cut.

Pass 1 tokenises each partition once, in its own order, and stages the ids with each document's place inside the
partition. The partitions' token totals alone are then summed up to give each partition its place in the one
long concatenation. Pass 2 rereads the ids and cuts them at fixed windows; a document or window that straddles two
partitions needs no exchange, because both sides know their global offsets. Windows that hold ids from several
partitions are marked as boundary records.

Nulls: a null text counts as empty, so it packs as the end token alone; a null doc_id is carried along. Repeated
rows are packed as often as they stand. No row is dropped. An empty table gives no piece. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clean_columns, small_batches, staged, table

WINDOW, END = 1024, 0
#: The totals of so many partitions (16 bytes each) are sent to every task; more are joined by a shuffle.
MOST_SENT = 1 << 20
#: Pieces without a break of at least so many characters go to the library whose merge loop isn't quadratic.
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


class Encoder:
    """Ids of ``byte_bpe_50k.json`` as ``tokenizers`` gives them, special tokens in the text included.

    The same vocabulary as ranks runs four times as fast for ordinary texts; both give the same ids.
    """

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        self.special = tuple(special)
        self.fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> list[int]:
        if (len(text) >= 1000 and LONG_RUN.search(text)) or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(json_path: str, ranks_path: str) -> Encoder:
    if (json_path, ranks_path) not in _encoders:
        _encoders[json_path, ranks_path] = Encoder(json_path, ranks_path)
    return _encoders[json_path, ranks_path]


def tokenised(docs: DataFrame, json_path: str, ranks_path: str, end: int = END) -> DataFrame:
    """Pass 1, staged: ``pid``, ``doc_id``, ``local`` (ids before it in its partition), ``n`` and ``ids`` (little-endian unsigned 16-bit)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path).encode
        pid, at = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [np.array([*encode(t or ""), end], "<u2").tobytes() for t in b.column(1).to_pylist()]
            n = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
            local = at + np.cumsum(n) - n
            at += int(n.sum())
            cols = [pa.array(np.full(len(ids), pid, np.int32)), b.column(0), pa.array(local), pa.array(n), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["pid", "doc_id", "local", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = clean_columns(docs, "doc_id", "text").mapInArrow(run, f"pid int, doc_id {kind}, local long, n long, ids binary")
    return staged(out, "pack-ids")


def pack(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length, boundary, ids``.

    ``padded_length``: ``window``, or the sequence's own length where that is a power of two.
    ``boundary``: the sequence holds ids of more than one partition.
    """
    spark = docs.sparkSession
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = tokenised(docs, json_path, ranks_path, end)
    totals = ids.groupBy("pid").agg(F.sum("n").alias("total"))
    running = F.sum("total").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    placed = totals.select("pid", "total", F.coalesce(running, F.lit(0)).alias("base"))
    # One row for each partition, so staging it is cheap and settles its size.
    placed = staged(placed.withColumn("whole", F.sum("total").over(Window.partitionBy())), "pack-offsets")
    side = F.broadcast(placed) if placed.count() <= MOST_SENT else placed
    joined = ids.join(side, "pid")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "boundary", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {k: b.column(k) for k in ("local", "n", "base", "total", "whole")}
            local, n, base, total, whole = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in col.values())
            first = base + local
            count = (first + n - 1) // window - first // window + 1
            row = np.repeat(np.arange(len(n)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            seq = first[row] // window + k
            lo = np.maximum(first[row], seq * window)
            hi = np.minimum(first[row] + n[row], (seq + 1) * window)
            start, length = lo - first[row], hi - lo
            blobs = b.column("ids").to_pylist()
            pieces = [blobs[r][2 * s : 2 * (s + m)] for r, s, m in zip(row.tolist(), start.tolist(), length.tolist())]
            crc = np.fromiter((zlib.crc32(np.frombuffer(p, "<u2").astype("<u4").tobytes()) for p in pieces), np.int64, len(pieces))
            filled = np.minimum(whole[row] - seq * window, window)
            power = (filled & (filled - 1)) == 0
            edge = (seq * window < base[row]) | (np.minimum((seq + 1) * window, whole[row]) > base[row] + total[row])
            cols = [b.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length, crc, n[row], seq, lo - seq * window, np.where(power, filled, window), edge)), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    kinds = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, boundary boolean, ids binary"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return joined.select("doc_id", "local", "n", "base", "total", "whole", "ids").mapInArrow(run, kinds)


def op6_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
