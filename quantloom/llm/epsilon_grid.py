"""Embedding near-dedup by an epsilon grid order join.

Vectors of one label (and one length) are compared by cosine in double precision. On unit vectors cosine >= t means
a Euclidean distance of at most eps = sqrt(2 - 2t). Equal vectors are joined into one class first. The classes are
turned onto principal axes and sorted by their grid cells (eps wide) on the leading ones, label first: the epsilon
grid order. The sequence is cut into blocks, each with the box of its leading coordinates; a tree over the sequence
holds the boxes of its intervals. Starting at the root, pairs of intervals are joined recursively: a pair whose
boxes lie more than eps apart, or in different labels, is dropped, any other gives the pairs of its children. The
tree's levels are joins of a few rows for each interval, whatever its contents. A pair of blocks that is left is one
group: inside it the recursion goes on down to intervals of FINE vectors, and these are compared by matrix products.

A group returns, for each vector with a link, how many vectors it is linked with there and one link of a spanning
forest, never the pairs. Of a pair of exact copies nothing is computed: a class adds its size less one to the links
of its members.

Axes: fitted on SAMPLE classes at most (those whose id hashes least). They only decide how well boxes separate;
every vector is joined exactly whatever they are.

Nulls: a vector with a null label, or that is null, empty, zero or holds a null or non-finite component, links with
nothing and is kept. Null or repeated vec_ids are allowed: rows are joined by vector, and ``component_id`` is the
least id of a component's rows. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clean_columns, small_batches, staged, table
from .components import connected_components
from .simhash import spanning

COSINE, AXES, BLOCK, FINE, FAN, SAMPLE = 0.98, 6, 2048, 128, 8, 4096


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    with np.errstate(over="ignore", under="ignore"):
        v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal_axes(v: np.ndarray, labels: np.ndarray, axes: int) -> np.ndarray:
    """Leading directions of the spread inside the labels, as columns."""
    v = v.copy()
    for x in np.unique(labels):
        v[labels == x] -= v[labels == x].mean(axis=0)
    _, vectors = np.linalg.eigh(v.T @ v)
    return vectors[:, ::-1][:, :axes]


def _fit(classes: DataFrame, sample: int, axes: int) -> dict[int, np.ndarray]:
    """For each vector length among the sample, its axes."""
    rows = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("dim", "label", "embedding").collect()
    out = {}
    for d in {r.dim for r in rows}:
        own = [r for r in rows if r.dim == d]
        labels = np.unique([str(r.label) for r in own], return_inverse=True)[1]
        out[d] = principal_axes(unit(np.array([r.embedding for r in own])), labels, axes)
    return out


def _coordinates(v: np.ndarray, fitted: dict[int, np.ndarray], axes: int) -> np.ndarray:
    turn = fitted.get(v.shape[1])
    turn = np.eye(v.shape[1])[:, :axes] if turn is None else turn  # a length that the sample lacks
    out = unit(v) @ turn
    return np.pad(out, ((0, 0), (0, axes - out.shape[1])))


def _vectors(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks_of(classes: DataFrame, eps: float, axes: int, block: int, sample: int) -> DataFrame:
    """Blocks of the sequence: ``seq, label, lo, hi, cids, sizes, data`` with ``seq`` numbered from 0 without gaps."""
    spark = classes.sparkSession
    fitted = _fit(classes, sample, axes)
    label_type = classes.schema["label"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                own = b.filter(pa.array(dims == d))
                v = _vectors(own.column("embedding"))
                cells = np.floor(_coordinates(v, fitted, axes) / eps).astype(np.int32)
                data = pa.array([x.tobytes() for x in np.ascontiguousarray(v)], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column("label"), own.column("dim"), own.column("cid"), own.column("size"), pa.array(list(cells)), data], ["label", "dim", "cid", "size", "cells", "data"])

    item = classes.schema["embedding"].dataType.elementType.simpleString()
    dtype = np.dtype(np.float32 if item == "float" else np.float64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    placed = staged(classes.mapInArrow(place, f"label {label_type}, dim int, cid long, size long, cells array<int>, data binary"), "ego-cells")
    # The id breaks ties, so that a cell holding many vectors can span several partitions.
    parts = max(1, -(-placed.count() // (16 * block)))
    ordered = placed.repartitionByRange(parts, "label", "dim", "cells", "cid").sortWithinPartitions("label", "dim", "cells", "cid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, held = TaskContext.get().partitionId(), 0, None

        def emit(t: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            v = np.frombuffer(b"".join(t.column("data").to_pylist()), dtype).reshape(t.num_rows, -1)
            y = _coordinates(v, fitted, axes)
            row = [pid, seq, t.column("label")[0], t.column("dim")[0], y.min(axis=0).tolist(), y.max(axis=0).tolist(), t.column("cid").to_numpy().astype("<i8").tobytes(), t.column("size").to_numpy().astype("<i8").tobytes(), v.tobytes()]
            seq += 1
            kinds = [pa.int32(), pa.int64(), t.schema.field("label").type, pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x.as_py() if isinstance(x, pa.Scalar) else x], k) for x, k in zip(row, kinds)], ["pid", "n", "label", "dim", "lo", "hi", "cids", "sizes", "data"])

        def full(t: pa.Table, last: bool) -> Iterator[pa.Table]:
            """Whole blocks of one label and length each; gives what is left at the end."""
            same = np.array([f"{a}/{b}" for a, b in zip(t.column("label").to_pylist(), t.column("dim").to_pylist())])
            edges = [0, *(np.flatnonzero(same[1:] != same[:-1]) + 1).tolist(), len(same)]
            for a, b in zip(edges, edges[1:]):
                for at in range(a, b, block):
                    end = min(b, at + block)
                    if end == len(same) and end - at < block and not last:
                        return t.slice(at)
                    yield t.slice(at, end - at)
            return t.slice(len(same))

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None and held.num_rows else t
            if t.num_rows:
                held = yield from _drain(full(t, False), emit)
        if held is not None and held.num_rows:
            yield from _drain(full(held, True), emit)

    kinds = f"pid int, n long, label {label_type}, dim int, lo array<double>, hi array<double>, cids binary, sizes binary, data binary"
    out = staged(ordered.mapInArrow(cut, kinds), "ego-blocks")
    count = out.groupBy("pid").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    base = count.select("pid", F.coalesce(before, F.lit(0)).alias("base"))
    return out.join(base, "pid").withColumn("seq", F.col("base") + F.col("n")).drop("pid", "n", "base")


def _drain(parts: Iterator, emit):
    while True:
        try:
            yield emit(next(parts))
        except StopIteration as end:
            return end.value


def block_pairs(boxes: DataFrame, eps: float, axes: int, fan: int = FAN) -> DataFrame:
    """Pairs ``a`` <= ``b`` of blocks that can hold vectors ``eps`` apart. ``boxes``: ``seq, label, dim, lo, hi``."""
    flat = boxes.select("seq", "label", "dim", *[F.col("lo")[i].alias(f"lo{i}") for i in range(axes)], *[F.col("hi")[i].alias(f"hi{i}") for i in range(axes)])
    flat = staged(flat.withColumn("key", F.struct("label", "dim")).drop("label", "dim"), "ego-boxes")
    top = flat.agg(F.max("seq")).first()[0] or 0
    levels = 0
    while fan**levels <= top:
        levels += 1

    def nodes(level: int, x: str) -> DataFrame:
        at = F.floor(F.col("seq") / fan**level).cast("long")
        least = [F.min("key").alias(f"first{x}"), F.max("key").alias(f"last{x}")]
        box = [F.min(f"lo{i}").alias(f"lo{x}{i}") for i in range(axes)] + [F.max(f"hi{i}").alias(f"hi{x}{i}") for i in range(axes)]
        return flat.groupBy(at.alias(x)).agg(*least, *box).withColumn("up", F.floor(F.col(x) / fan).cast("long"))

    pairs = boxes.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    slack = eps * eps * (1 + 1e-9) + 1e-12
    for level in range(levels - 1, -1, -1):
        a = nodes(level, "a").withColumnRenamed("up", "upa")
        b = nodes(level, "b").withColumnRenamed("up", "upb")
        up = pairs.select(F.col("a").alias("upa"), F.col("b").alias("upb"))
        joined = up.join(a, "upa").join(b, "upb").where("a <= b and firsta <= lastb and firstb <= lasta")
        gap = [F.greatest(F.col(f"loa{i}") - F.col(f"hib{i}"), F.col(f"lob{i}") - F.col(f"hia{i}"), F.lit(0.0)) for i in range(axes)]
        pairs = joined.where(sum((g * g for g in gap), F.lit(0.0)) <= slack).select("a", "b")
    return pairs


def join_blocks(u: np.ndarray, v: np.ndarray, same: bool, fitted_axes: int, t: float, fine: int = FINE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two blocks of unit vectors linked at cosine ``t``, a few intervals at a time."""
    eps2 = (2 - 2 * t) * (1 + 1e-9) + 1e-12
    cu, cv = u[:, :fitted_axes], v[:, :fitted_axes]

    def box(c: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        return c[lo:hi].min(axis=0), c[lo:hi].max(axis=0)

    stack = [(0, len(u), 0, len(v))]
    while stack:
        a, b, c, d = stack.pop()
        if a >= b or c >= d or (same and a >= d):
            continue
        (la, ha), (lb, hb) = box(cu, a, b), box(cv, c, d)
        gap = np.maximum(np.maximum(la - hb, lb - ha), 0)
        if (gap * gap).sum() > eps2:
            continue
        if b - a <= fine and d - c <= fine:
            near = u[a:b, fitted_axes:] @ v[c:d, fitted_axes:].T
            i, j = np.nonzero(near >= t - 1e-12)
            i, j = i + a, j + c
            # On the edge the plain sum decides, not the order that a matrix product adds in.
            edge = np.abs(near[i - a, j - c] - t) <= 1e-12
            if edge.any():
                exact = (u[i[edge], fitted_axes:] * v[j[edge], fitted_axes:]).sum(axis=1)
                keep = np.ones(len(i), bool)
                keep[np.flatnonzero(edge)[exact < t]] = False
                i, j = i[keep], j[keep]
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        m, n = (a + b) // 2 if b - a > fine else b, (c + d) // 2 if d - c > fine else d
        stack += [(x, y, p, q) for x, y in ((a, m), (m, b)) for p, q in ((c, n), (n, d))]


def ego_join(vectors: DataFrame, cosine: float = COSINE, axes: int = AXES, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vec_id, embedding, label``."""
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine))
    rows = clean_columns(vectors, "vec_id", "embedding", "label")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    live = F.col("label").isNotNull() & F.coalesce(~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(live)
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = classes.withColumn("dim", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id())
    classes = staged(classes, "ego-classes")
    blocks = staged(blocks_of(classes, eps, axes, block, sample), "ego-sequence")
    pairs = block_pairs(blocks.select("seq", "label", "dim", "lo", "hi"), eps, axes)
    left = blocks.join(pairs, blocks.seq == pairs.a).select("a", "b", F.lit(0).alias("side"), "dim", "cids", "sizes", "data")
    right = blocks.join(pairs.where("a <> b"), F.col("seq") == F.col("b")).select("a", "b", F.lit(1).alias("side"), "dim", "cids", "sizes", "data")
    wide = classes.schema["embedding"].dataType.elementType.simpleString() == "double"
    dtype = np.dtype(np.float64 if wide else np.float32)
    fitted = _fit(classes, sample, axes)

    def run(t: pa.Table) -> pa.Table:
        sides = sorted(t.select(["side", "dim", "cids", "sizes", "data"]).to_pylist(), key=lambda r: r["side"])
        got = []
        for r in sides:
            raw = np.frombuffer(r["data"], dtype).reshape(-1, r["dim"])
            got.append((np.hstack([_coordinates(raw, fitted, axes), unit(raw)]), np.frombuffer(r["cids"], "<i8"), np.frombuffer(r["sizes"], "<i8")))
        (u, cu, su), (v, cv, sv) = got[0], got[-1]
        same = len(got) == 1
        if not same and sides[0]["dim"] != sides[1]["dim"]:
            return pa.table({"cid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        nu, nv = np.zeros(len(u), np.int64), np.zeros(len(v), np.int64)
        if same:
            nv = nu
        a = b = np.empty(0, np.int64)
        for i, j in join_blocks(u, v, same, axes, cosine):
            np.add.at(nu, i, sv[j])
            np.add.at(nv, j, su[i])
            a, b = spanning(np.concatenate([a, cu[i]]), np.concatenate([b, cv[j]]))
        root = dict(zip(a.tolist(), b.tolist()))
        ids = np.concatenate([cu[nu > 0], cv[nv > 0]] if not same else [cu[nu > 0]])
        links = np.concatenate([nu[nu > 0], nv[nv > 0]] if not same else [nu[nu > 0]])
        return pa.table({"cid": ids, "links": links, "root": np.array([root.get(x, x) for x in ids.tolist()], np.int64)})

    found = left.unionByName(right).groupBy("a", "b").applyInArrow(run, "cid long, links long, root long")
    found = staged(found, "ego-links")
    degree = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    placed = classes.join(degree, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    placed = placed.select("label", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("label", "embedding", "n_links", "component_id")
    out = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~live).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    out = out.unionByName(alone)
    small_batches(spark)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join(table(spark, sf_dir, "embeddings"))
