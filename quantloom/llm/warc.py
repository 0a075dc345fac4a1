"""WARC archives: a writer of monolithic gzip files, a normaliser of them, and a reader by offset.

A monolithic file is one gzip stream over all its records, so that no record can be read without all before it. The
normaliser inflates such a stream once, from end to end and in constant memory, writes every record as a gzip member
of its own, and beside the archive a sidecar index: a JSON line for each record with its offset and length in the
file, its id, type and digest. The reader opens archives by that index, one member at a time.

Files are written by the executors through ``pyarrow.fs`` to the folder in spark.checkpoint.dir, under names that
hold the task attempt; a staged manifest lists the files of the attempts that counted, so a lost executor leaves
stray files but never a wrong archive. One archive is one task, from MOST_RECORDS records on a new one begins.

Nulls: a null payload counts as empty; a null url is written as an empty one; line breaks and control characters in
a url are percent-encoded. A null page_id gives a record without one, which refers to nothing and to which nothing
refers. Rows that agree in page_id and payload each give a record of the same type. Other columns are ignored; an
empty table gives no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_columns, drop_stage, small_batches, stage_path, staged, table

LEAST, CHUNK, MOST_RECORDS, MOST_SENT = 100, 1 << 20, 50_000, 1 << 19
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(record: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record or "")
    return int(m[1]) if m else None


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """A response, or a revisit of ``refers_to``, whose block has the HTTP head alone."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Record-ID": record_id(page_id), "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is None:
        return record("response", headers, head + payload)
    return record("revisit", {**headers, "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}, head)


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """The contents of a gzip file of one or more members, a chunk at a time. A member without its end is an error, wherever its records end."""
    z, begun = zlib.decompressobj(31), False
    while data := source.read(CHUNK):
        while data:
            begun = True
            if out := z.decompress(data, CHUNK):
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z, begun = z.unused_data, zlib.decompressobj(31), False
    if out := z.flush():
        yield out
    if begun and not z.eof:
        raise ValueError("the archive ends inside a gzip member")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record. ``headers[""]`` is the version line."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        at, from_ = -1, 0
        while (at := held.find(b"\r\n\r\n", from_)) < 0:
            from_ = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("the archive ends inside a record")
                return
        version, *lines = bytes(held[:at]).decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        headers = {"": version} | {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers["Content-Length"])
        if not fill(at + 4 + n + 4):
            raise ValueError("the archive ends inside a record")
        block = bytes(held[at + 4 : at + 4 + n])
        del held[: at + 8 + n]
        yield headers, block


def payload_of(block: bytes) -> tuple[int, bytes]:
    """Length of the payload that an HTTP message announces, and what of it is there."""
    head, _, payload = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?i)^content-length: *(\d+)", head, re.M)
    return int(m[1]) if m else len(payload), payload


def normalise(source: BinaryIO, target: BinaryIO) -> Iterator[dict]:
    """Writes each record of ``source`` as a gzip member of ``target`` and gives its index line."""
    offset = 0
    for headers, block in records(inflated(source)):
        head = "\r\n".join([headers[""], *(f"{k}: {v}" for k, v in headers.items() if k)])
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()
        target.write(member)
        yield {"offset": offset, "length": len(member), "id": headers.get("WARC-Record-ID", ""), "type": headers["WARC-Type"], "digest": headers.get("WARC-Payload-Digest", ""), "uri": headers.get("WARC-Target-URI", "")}
        offset += len(member)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _attempt() -> str:
    t = TaskContext.get()
    return f"{t.partitionId():06d}-{t.taskAttemptId()}"


def write_monolithic(pages: DataFrame) -> DataFrame:
    """Writes ``page_id, url, payload, digest, refers_to`` rows to monolithic archives. Returns the manifest (``uri``, ``records``)."""
    spark = pages.sparkSession
    folder = stage_path(spark, "warc-whole")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: list[tuple[str, int]] = []
        out, z, n = None, None, 0
        where, base = _open(folder)
        where.create_dir(base, recursive=True)

        def close() -> None:
            out.write(z.flush())
            out.close()
            files[-1] = (files[-1][0], n)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None or n >= MOST_RECORDS:
                    if out is not None:
                        close()
                    name = f"{_attempt()}-{len(files):03d}.warc.gz"
                    files.append((f"{folder}/{name}", 0))
                    out, z, n = where.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0
                    out.write(z.compress(record("warcinfo", {"WARC-Record-ID": f"<urn:file:{name}>", "Content-Type": "application/warc-fields"}, b"software: quantloom\r\n")))
                out.write(z.compress(page_record(*row)))
                n += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files], pa.string()), pa.array([k for _, k in files], pa.int64())], ["uri", "records"])

    rows = pages.select("page_id", "url", "payload", "digest", "refers_to")
    out = staged(rows.mapInArrow(run, "uri string, records long"), "warc-manifest")
    out._folder = folder
    return out


def normalise_archives(manifest: DataFrame) -> DataFrame:
    """Normalises each archive of ``manifest``. Returns a manifest of the new ones (``uri``, ``index``, ``records``)."""
    spark = manifest.sparkSession
    folder = stage_path(spark, "warc-members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(folder)
        where.create_dir(base, recursive=True)
        for b in batches:
            for uri in b.column("uri").to_pylist():
                name = f"{_attempt()}-{uri.rpartition('/')[2]}"
                source, path = _open(uri)
                n = 0
                with source.open_input_stream(path, compression=None) as whole, where.open_output_stream(f"{base}/{name}", compression=None) as out, where.open_output_stream(f"{base}/{name}.idx", compression=None) as idx:
                    for line in normalise(whole, out):
                        idx.write(json.dumps(line).encode() + b"\n")
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([f"{folder}/{name}.idx"]), pa.array([n], pa.int64())], ["uri", "index", "records"])

    return staged(_one_each(manifest.select("uri")).mapInArrow(run, "uri string, index string, records long"), "warc-manifest")


def _one_each(manifest: DataFrame) -> DataFrame:
    """A task for each archive, as far as counts go."""
    return manifest.repartition(max(1, manifest.count()))


def read_archives(manifest: DataFrame) -> DataFrame:
    """The page records of normalised archives, each read by its offset: ``page_id, uri, payload_bytes, payload_digest, record_type, refers_to, payload``."""
    small_batches(manifest.sparkSession)
    names = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, index in zip(b.column("uri").to_pylist(), b.column("index").to_pylist()):
                where, path = _open(uri)
                _, at = _open(index)
                with where.open_input_stream(at, compression=None) as f:
                    lines = [json.loads(x) for x in f.read().splitlines()]
                held: list[tuple] = []
                with where.open_input_file(path) as f:
                    for line in lines:
                        if line["type"] not in ("response", "revisit"):
                            continue
                        f.seek(line["offset"])
                        (headers, block), *more = records(iter([zlib.decompress(f.read(line["length"]), 31)]))
                        if more or headers["WARC-Record-ID"] != line["id"]:
                            raise ValueError(f"{uri}: the index is wrong at {line['offset']}")
                        size, payload = payload_of(block)
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if line["type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{uri}: a payload at {line['offset']} doesn't have its digest")
                        held.append((_page(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, line["type"], _page(headers.get("WARC-Refers-To")), payload if line["type"] == "response" else None))
                        if len(held) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    kinds = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return _one_each(manifest).mapInArrow(run, kinds)


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: later pages of an equal payload of ``least`` bytes refer to the first."""
    t = clean_columns(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"))
    t = t.withColumn("digest", F.sha2("payload", 256))
    shared = t.where(F.octet_length("payload") >= least).select("page_id", "digest").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    shared = staged(shared, "warc-shared")
    shared = F.broadcast(shared) if shared.count() <= MOST_SENT else shared
    t = t.join(shared, "digest", "left")
    return t.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = write_monolithic(with_revisits(table(spark, sf_dir, "pages")))
    members = normalise_archives(whole)
    whole._stage_path = whole._folder
    drop_stage(whole)  # the monolithic files; what follows reads the normalised ones
    return read_archives(members).drop("payload", "uri")
