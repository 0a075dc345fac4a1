"""Ball k-means: exact Lloyd rounds in which a vector meets only the centroids that its cluster's ball can reach.

Vectors are integers (floor of SCALE times a component), so that distances, ties and means are exact and don't depend
on partitions. Each vector is stored with a home cluster. A home is a ball: its centroid, and a radius that covers
all members. Centroid j is a neighbour of ball i only if it lies within twice the radius. Of a ball's members, those
nearer to the centroid than half the way to the nearest neighbour form the stable core and are compared with nothing.
The others lie in annuli between half the ways to successive neighbours, and a member of the m-th annulus is
compared exactly with the m nearest neighbours.

A round is one narrow pass over the stored vectors that returns sums, counts and radii, K rows a task; nothing is
written. Only when more than MOVED of the vectors have left their homes they are written again with new homes, so a
table of any size is written a few times and read once a round. Rounds end early when no centroid moves: what is left
would change nothing. The driver holds K centroids, whose size is a parameter (MOST_NUMBERS at most in all).

Rows: a vector is left out if it is null, has another number of components, holds a null or non-finite one or one
beyond the range in which squared distances fit a long (65,536 at 64 components). With fewer vectors than clusters
every vector starts one. Repeated and null ids are allowed: rows are vectors, a null id hashes as an empty one, and
equal hashes start in the order of their components. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, clean_columns, table

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Share of the vectors away from their homes at which they are written anew.
MOVED = 0.1
#: Components of all centroids together, which every task is sent.
MOST_NUMBERS = 1 << 22

Neighbours = list[list[tuple[int, int]]]


def integer_vectors(df: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: the vectors that take part, as integers."""
    most = isqrt((1 << 60) // dims) // 2
    inside = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < most), F.lit(False))
    e = clean_columns(df, "vec_id", "embedding").where((F.size("embedding") == dims) & F.forall("embedding", inside))
    return e.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def start_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors whose ids hash least, ``clusters`` of them."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()]


def _root_above(x: int) -> int:
    return isqrt(x - 1) + 1 if x > 0 else 0


def _squared(a: list[int], b: list[int]) -> int:
    return sum((p - q) ** 2 for p, q in zip(a, b))


def neighbours(centroids: list[list[int]], radii: list[int] | None = None) -> Neighbours:
    """For each ball the other centroids within twice its radius (all where it isn't known), nearest first, with their squared distance."""
    gaps = [sorted((_squared(a, b), j) for j, b in enumerate(centroids) if j != i) for i, a in enumerate(centroids)]
    return [[(j, g) for g, j in own if radii is None or g <= (2 * radii[i]) ** 2] for i, own in enumerate(gaps)]


def nearest(v: np.ndarray, home: np.ndarray, centroids: np.ndarray, near: Neighbours) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, squared distance to it and squared distance to the home's centroid of each row of ``v``."""
    cluster, best, own = home.copy(), np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    for i in np.unique(home):
        rows = np.flatnonzero(home == i)
        x = v[rows]
        at_home = ((x - centroids[i]) ** 2).sum(axis=1)
        b, c = at_home.copy(), np.full(len(rows), i)
        for j, gap in near[i]:
            # Nearer than half the way: the triangle inequality makes every centroid at this gap or beyond farther.
            out = np.flatnonzero(4 * at_home >= gap)
            if not len(out):
                break
            d = ((x[out] - centroids[j]) ** 2).sum(axis=1)
            closer = out[(d < b[out]) | ((d == b[out]) & (j < c[out]))]
            b[closer], c[closer] = ((x[closer] - centroids[j]) ** 2).sum(axis=1), j
        cluster[rows], best[rows], own[rows] = c, b, at_home
    return cluster, best, own


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def homed(vectors: DataFrame, centroids: list[list[int]], near: Neighbours) -> DataFrame:
    """``vec_id, v, home``: each vector at its nearest centroid; ``home``, if it is there, says where to begin."""
    c = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home = b.column("home").to_numpy() if "home" in b.schema.names else np.zeros(b.num_rows, np.int32)
            to = nearest(_matrix(b.column("v")), home, c, near)[0]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(to, pa.int32())], ["vec_id", "v", "home"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, v array<int>, home int")


def round_totals(vectors: DataFrame, centroids: list[list[int]], near: Neighbours) -> DataFrame:
    """One row a cluster and component: ``cluster, place, total, n, radius2, moved``; the last three repeat for each component.

    ``n`` and ``total`` are of the cluster's vectors now; ``radius2`` (greatest squared distance) and ``moved`` of those whose home it is.
    """
    c = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, moved, radius, total = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for b in batches:
            v, home = _matrix(b.column("v")), b.column("home").to_numpy()
            to, _, own = nearest(v, home, c, near)
            n += np.bincount(to, minlength=len(c))
            moved += np.bincount(home[to != home], minlength=len(c))
            np.maximum.at(radius, home, own)
            for i in np.unique(to):
                total[i] += v[to == i].sum(axis=0)
        if n.any():
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(len(c)), pa.int32()), "n": n, "moved": moved, "radius2": radius, "totals": pa.array(list(total), pa.list_(pa.int64()))})

    parts = vectors.select("v", "home").mapInArrow(run, "cluster int, n long, moved long, radius2 long, totals array<long>")
    parts = parts.select("cluster", "n", "moved", "radius2", F.posexplode("totals").alias("place", "x"))
    return parts.groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"), F.max("radius2").alias("radius2"), F.sum("moved").alias("moved"))


def _moved_centroids(rows: list, centroids: list[list[int]]) -> tuple[list[list[int]], list[int], int, int]:
    """The next centroids (floors of means; a cluster without vectors stays), radii about them, and how many vectors moved, of how many."""
    new = [list(c) for c in centroids]
    radius, n, moved = [0] * len(centroids), [0] * len(centroids), [0] * len(centroids)
    for r in rows:
        if r.n:
            new[r.cluster][r.place] = int(r.total) // r.n
        radius[r.cluster], n[r.cluster], moved[r.cluster] = r.radius2, r.n, r.moved
    # About a centroid that moved by s the ball of radius r lies within r + s.
    radii = [_root_above(r) + _root_above(_squared(a, b)) for r, a, b in zip(radius, centroids, new)]
    return new, radii, sum(moved), sum(n)


def ball_kmeans(vectors: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` (staged) of ``vectors`` (vec_id, v), and the centroids, after ``rounds`` rounds and a last assignment."""
    if sum(map(len, centroids)) > MOST_NUMBERS:
        raise ValueError(f"more than {MOST_NUMBERS} components in the centroids")
    stages = Stages()
    near = neighbours(centroids)
    at = stages.staged(homed(vectors, centroids, near), "balls")
    for _ in range(rounds):
        new, radii, moved, rows = _moved_centroids(round_totals(at, centroids, near).collect(), centroids)
        if new == centroids:
            break
        centroids, near = new, neighbours(new, radii)
        if moved > MOVED * rows:
            last, at = stages, Stages().staged(homed(at, centroids, near), "balls")
            last.drop()
            stages = Stages()
            stages.hold(at)
            near = neighbours(centroids)
    c = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to, d, _ = nearest(_matrix(b.column("v")), b.column("home").to_numpy(), c, near)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(to, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    kind = at.schema["vec_id"].dataType.simpleString()
    out = Stages().staged(at.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "ball-clusters")
    stages.drop()
    return out, centroids


def clusters(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of the vectors of ``df`` (vec_id, embedding)."""
    spark = df.sparkSession
    vectors = integer_vectors(df)
    start = start_centroids(vectors, k)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not start:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found, centroids = ball_kmeans(vectors, start, rounds)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    about = [(i, s, sum(sums.values()), digest(centroids[i])) for i, s in sums.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))
