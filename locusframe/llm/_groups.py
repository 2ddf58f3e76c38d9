"""Comparing the members of groups of any size, in parts of bounded size, and joining what is linked.

Joins on a group or a node may have hot keys on their left side; adaptive execution splits those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import stored

ROUNDS = 60
#: Members and summed sizes of a block, and members of a group that all others meet first.
BLOCK_MEMBERS, BLOCK_SIZE, PIVOTS = 256, 1 << 19, 12


def joined(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node but the roots, by alternating large and small stars.

    edges has two columns of one integer type, a and b; edges with a null, and of a node with itself, join nothing.
    Each round replaces the edges by ones that point at smaller nodes and is written to the shared folder; it ends
    when every edge points from a node with no other edge to one that has none of its own.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(ROUNDS):
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        if not ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 OR out = 1 AND in = 1").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"the components did not settle in {ROUNDS} rounds")


def _main_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, pivots, c) sorted by group, c members that meet the same pivots, to the pivots of each group's largest component."""
    name, root, count = None, {}, {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def out() -> pa.RecordBatch:
        sums: dict[int, int] = {}
        for x, c in count.items():
            sums[find(x)] = sums.get(find(x), 0) + c
        main = min(sums, key=lambda x: (-sums[x], x))
        some = [x for x in root if find(x) == main]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.int64()), pa.array(some, pa.int64())], names=["group", "pivot"])

    for b in batches:
        for group, pivots, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if group != name:
                if root:
                    yield out()
                name, root, count = group, {}, {}
            for x in pivots:
                root.setdefault(x, x)
                root[find(x)] = find(pivots[0])
            count[pivots[0]] = count.get(pivots[0], 0) + c
    if root:
        yield out()


def group_links(grouped: DataFrame, sets: DataFrame, meet: Callable, walk: Callable) -> DataFrame:
    """Edges (a, b) that join the linked members of each group into their components.

    grouped has (sig, size, group), each sig in one group; sets has sig and columns that the functions read.
    walk gets batches of (part, core, sig, ...), sorted by part, and yields the links of each part's
    members; those of core are joined already.  meet gets (sig, ..., pivots), pivots being a list of such rows,
    and yields links (a, b) of members with pivots.

    A group of one block is one part.  The members of a larger one first meet a few pivots; those linked to
    the pivots' main component are the core.  Blocks of the others are compared with each other and with the core's.
    """
    columns = sets.columns
    sums = grouped.groupBy("group").agg(F.count("*").alias("m"), F.sum("size").alias("w")).filter("m > 1")
    sums = sums.select("group", "m", F.greatest(F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(F.col("w") / BLOCK_SIZE)).alias("blocks"))
    sized = stored(grouped.join(sums, "group").select("sig", "group", "m", "blocks"))
    alone = sized.filter("blocks = 1").select("sig", F.col("group").cast("string").alias("part"), F.lit(False).alias("core"))
    several = sized.filter("blocks > 1")
    if not several.limit(1).count():
        return _walked(alone, sets, walk)

    salts = F.ceil(F.col("m") / (4 * BLOCK_MEMBERS))
    large = several.select("sig", "group", "m", F.pmod(F.xxhash64("sig", F.lit(2)), salts).alias("salt")).join(sets, "sig")
    picked = large.filter(F.pmod(F.xxhash64("sig"), F.ceil(F.col("m") / PIVOTS)) == 0)
    pivots = picked.groupBy("group").agg(F.first("m").alias("m"), F.collect_list(F.struct(*columns)).alias("pivots"))
    pivots = pivots.select("group", "pivots", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    met = stored(large.join(pivots, ["group", "salt"]).select(*columns, "pivots").mapInArrow(meet, "a long, b long"))

    # the pivots that each member meets, itself included if it is one; few kinds for each group
    pivot = picked.select("sig", "group")
    each = met.join(pivot.select(F.col("sig").alias("b"), "group"), "b").select("group", F.col("a").alias("sig"), F.col("b").alias("pivot"))
    each = each.unionByName(pivot.select("group", "sig", F.col("sig").alias("pivot"))).groupBy("group", "sig").agg(F.sort_array(F.collect_set("pivot")).alias("pivots"))
    each = stored(each)
    main = each.groupBy("group", "pivots").agg(F.count("*").alias("c")).repartition("group").sortWithinPartitions("group").mapInArrow(_main_pivots, "group long, pivot long")
    core = each.select("sig", F.element_at("pivots", 1).alias("pivot")).join(main.select("pivot"), "pivot").select("sig", F.lit(True).alias("core"))
    split = stored(several.join(core, "sig", "left").withColumn("core", F.coalesce("core", F.lit(False))))
    sides = split.groupBy("group").agg(F.sum(F.col("core").cast("long")).alias("c"), F.first("m").alias("m"), F.first("blocks").alias("blocks"))
    share = lambda x: F.ceil(F.col("blocks") * x / F.col("m")).cast("int")
    sides = sides.select("group", share(F.col("c")).alias("gc"), share(F.col("m") - F.col("c")).alias("gn")).filter("gn > 0")
    at = F.pmod(F.xxhash64("sig", F.lit(1)), F.when(F.col("core"), F.greatest("gc", F.lit(1))).otherwise(F.col("gn"))).cast("int")
    placed = split.drop("m", "blocks").join(sides, "group").withColumn("at", at)
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def name(kind: str, i: Column, j: Column) -> Column:
        return F.concat_ws(":", F.col("group").cast("string"), F.lit(kind), i.cast("string"), j.cast("string"))

    with_core = F.transform(up_to(F.col("gc")), lambda i: name("c", i, F.col("at")))
    among = F.transform(up_to(F.col("gn")), lambda j: name("n", F.least(j, F.col("at")), F.greatest(j, F.col("at"))))
    of_core = F.transform(up_to(F.col("gn")), lambda j: name("c", F.col("at"), j))
    parts = placed.select("sig", F.explode(F.when(F.col("core"), of_core).otherwise(F.concat(with_core, among))).alias("part"), "core")
    return met.unionByName(_walked(alone.unionByName(parts.select(*alone.columns)), sets, walk))


def _walked(parts: DataFrame, sets: DataFrame, walk: Callable) -> DataFrame:
    parts = parts.join(sets, "sig").select("part", "core", *sets.columns)
    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(walk, "a long, b long")
