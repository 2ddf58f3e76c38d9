"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a budget of words.  Whole rounds of the source come first; for what
remains, documents are counted by exact length, most of the budget is dealt to the
lengths in proportion, and a bounded-knapsack program fits the rest, or the whole budget
where that is small and comes nearer.  Documents are
then chosen by a seeded hash, as many of each length as the plan says.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ._common import stored

WORD = "[^\\x20\\x09-\\x0D]+"
#: The knapsack program covers budgets up to so many words.
KNAPSACK_WORDS = 65_536
#: Documents of one length are ranked within buckets of about so many.
BUCKET_ROWS = 1000


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, so that their words come as near the budget as the program gets, from below."""
    total = int((sizes * counts).sum())
    budget = max(0, min(int(budget), total))
    if total == 0:
        return np.zeros_like(counts)
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((sizes * taken).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= KNAPSACK_WORDS:
            break
        more = min(int(counts[i] - taken[i]), (rest - KNAPSACK_WORDS // 2) // int(sizes[i])) if sizes[i] else 0
        taken[i] += max(0, more)
        rest -= max(0, more) * int(sizes[i])
    if rest > KNAPSACK_WORDS:  # every size with documents left is over half the rest now, so one more fits at most
        fits = np.flatnonzero((counts > taken) & (sizes <= rest) & (sizes > 0))
        if len(fits):
            best = fits[np.argmax(sizes[fits])]
            taken[best] += 1
            rest -= int(sizes[best])
    taken = taken + _knapsack(sizes, counts - taken, rest)
    missed = budget - int((sizes * taken).sum())
    if missed and budget <= KNAPSACK_WORDS:  # the lengths dealt first may stand in the way of an exact fit
        exact = _knapsack(sizes, counts, budget)
        taken = exact if int((sizes * exact).sum()) > budget - missed else taken
    return taken


def _knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack over reachable sums, kept as the bits of an integer."""
    out = np.zeros_like(counts)
    budget = min(budget, KNAPSACK_WORDS)
    mask, reach = (1 << (budget + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        size, left, lot = int(sizes[i]), int(counts[i]), 1
        if not 0 < size <= budget:
            continue
        left = min(left, budget // size)
        while left and not reach >> budget & 1:
            n = min(lot, left)
            steps.append((i, n, reach))
            reach |= (reach << (n * size)) & mask
            left, lot = left - n, lot * 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            out[i] += n
            at -= n * int(sizes[i])
    return out


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, none (1 for the null source), source_size and target; one row per source.

    Sources by code point, null last, weigh as the repeated weights; a target stops at cap
    times its source's size, the excess going to the others by weight.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(n - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("w", weigh).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    # filled in order of limit per weight: sources before the first that is not full are full
    order = W.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    past, ahead = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    by = by.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.coalesce(F.sum("limit").over(past), F.lit(0.0))) / F.sum("w").over(ahead))
    open_ = F.col("level") <= F.col("limit") / F.col("w")
    by = by.withColumn("level", F.first(F.when(open_, F.col("level")), ignorenulls=True).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("w")))
    return by.select("source", F.col("source").isNull().cast("int").alias("none"), "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) of every document.

    A size is the number of runs of non-white-space (null text: 0).  A document is taken
    0, 1 or 2 times whole, never more than cap says.  A source's taken words miss its
    target by less than its shortest unused document; a source of empty texts takes none.
    Among documents of equal size a seeded hash of id and text decides, so reruns agree;
    repeated rows are documents of their own.  A null source is a source, null ids are
    kept, an empty table gives an empty result; other columns are not read.
    """
    d = F.coalesce(F.col("text"), F.lit(""))
    sized = stored(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
        .select("doc_id", "source", F.regexp_count(d, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", d).alias("h"))
    )
    sized = sized.withColumn("none", F.col("source").isNull().cast("int")).withColumn("source", F.coalesce("source", F.lit("")))
    targets = source_targets(sized.withColumn("source", F.when(F.col("none") == 0, F.col("source"))), weights, share, cap).withColumn("source", F.coalesce("source", F.lit("")))
    lengths = sized.groupBy("source", "none", "size").agg(F.count("*").alias("n")).join(targets, ["source", "none"])

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        sizes, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        whole, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        rounds = int(target // whole) if whole else 0
        return group.assign(rounds=rounds, take=fit_counts(sizes, counts, round(target - rounds * whole)))

    plan_schema = "source string, none int, size long, n long, source_size long, target double, rounds int, take long"
    plans = stored(lengths.groupBy("source", "none").applyInPandas(plan, plan_schema))
    key = ["source", "none", "size"]
    bucket = F.pmod(F.col("h"), F.ceil(F.col("n") / BUCKET_ROWS)).alias("bucket")
    dealt = sized.join(plans, key).select(*key, "doc_id", "h", "source_size", "target", "rounds", "take", bucket)
    # the first `take` documents in order of bucket and hash, without ranking a whole length in one task
    filled = dealt.groupBy(*key, "take", "bucket").agg(F.count("*").alias("there"))
    before = F.coalesce(F.sum("there").over(W.partitionBy(*key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    quotas = filled.select(*key, "bucket", (F.col("take") - before).alias("quota"))
    place = F.row_number().over(W.partitionBy(*key, "bucket").orderBy("h", "doc_id"))
    chosen = dealt.join(quotas, [*key, "bucket"]).withColumn("extra", (place <= F.col("quota")).cast("long"))
    return chosen.select("doc_id", "size", "source_size", "target", ((F.col("rounds") + F.col("extra")) * F.col("size")).alias("taken"))
