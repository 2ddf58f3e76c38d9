"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import stored

ROUNDS = 60
#: A node is a hub if it has more edges than this, and than one in so many of all edges.
HUB_EDGES, HUB_SHARE = 1000, 10_000


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Join on a key of which right has one row with the number of left's rows, of total.

    The keys of hubs, at most HUB_SHARE of them, are broadcast, so that their rows are not shuffled to one task.
    """
    hub = F.col(count) > max(HUB_EDGES, total // HUB_SHARE)
    hot = F.broadcast(right.filter(hub))
    rest = left.join(F.broadcast(right.filter(hub).select(key)), key, "left_anti").join(right.filter(~hub), key)
    return left.join(hot, key).unionByName(rest)


def _lowest(edges: DataFrame, low: DataFrame, count: int) -> DataFrame:
    """u, v and m, the least node next to u."""
    return join_counted(edges, low, "u", "c", count)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node but the roots.

    edges has two columns of one integer type, a and b; edges with a null, and of a node with itself, join
    nothing.  Each round replaces the edges by ones that point at smaller nodes; it ends when nothing
    changes.  Every round is written to the shared folder, so neither lineage nor the driver's memory grows.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    count, state = e.count(), None
    for _ in range(ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = stored(_lowest(both, low, 2 * count).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = _lowest(large, low, count).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, count = now, now[0]
    raise RuntimeError(f"the components did not settle in {ROUNDS} rounds")
