"""Connected components of an edge table, by repeated contraction with DataFrame operations alone.

Each round maps every node to the neighbour that ranks least under a fresh hash, follows that map once more and
replaces the edges' ends. A round shrinks every component by a constant factor however its ids are ordered, so the
number of rounds grows as the logarithm of the largest component. Hubs are harmless: the least neighbour is a
combinable aggregate, and the lookup side of each join has one row per node, so a hub only skews the other side,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, staged

MAX_ROUNDS = 64


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns ``u`` and ``v`` (long). Returns ``node`` and ``root`` for each node of an edge.

    ``root`` is one node of the component (not the least one). Nulls, loops and repeated edges are ignored; an
    empty edge table gives an empty result.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = staged(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    maps = []
    for k in range(MAX_ROUNDS):
        if e.isEmpty():
            break
        rank = lambda c, seed=k: F.struct(F.xxhash64(F.lit(seed), c).alias("r"), c.alias("n"))
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m"))
        first = least.select(F.col("u").alias("node"), F.least(F.col("m"), rank(F.col("u")))["n"].alias("to"))
        first = staged(first, "cc-step")
        second = first.select(F.col("node").alias("mid"), F.col("to").alias("root"))
        step = staged(first.join(second, F.col("to") == F.col("mid")).select("node", "root"), "cc-map")
        maps.append(step)
        drop_stage(first)
        a = step.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = step.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        up = e.join(a, "u").join(b, "v").where("ru <> rv")
        up = up.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        last, e = e, staged(up, "cc-edges")
        drop_stage(last)
    else:
        raise RuntimeError("the components did not settle")
    if not maps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = maps[-1]
    for step in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("mid"), F.col("root").alias("end"))
        joined = step.join(later, F.col("root") == F.col("mid"), "left")
        out = joined.select("node", F.coalesce("end", "root").alias("root"))
    out = staged(out, "cc-roots")
    for step in [*maps, e]:
        drop_stage(step)
    return out
