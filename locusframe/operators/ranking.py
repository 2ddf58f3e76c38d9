"""Ranks of submissions and their comparison with templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .metrics import in_ranges


def average_rank(value: Column, keys: list[Column | str], descending: bool = True) -> Column:
    """Rank with ties averaged, over the keys."""
    order = value.desc() if descending else value.asc()
    first = F.rank().over(W.partitionBy(*keys).orderBy(order))
    return first + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / 2.0


def average_ranks(df: DataFrame, value: str, keys: list[str], out: str = "rank", descending: bool = True) -> DataFrame:
    """Add the same rank of a column without sorting a whole key in one task.

    Equal values are counted first; places are counted within ranges of values, to which the rows of the ranges
    before are added.  Null values rank last if descending, else first, as one value.
    """
    per = in_ranges(df.groupBy(*keys, value).agg(F.count("*").alias("__n")), value)
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    past = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = per.groupBy(*keys, "part").agg(F.sum("__n").alias("__of_part"))
    before = past(W.partitionBy(*keys).orderBy(order("part")), "__of_part").alias("__before")
    sums = sums.select(*[F.col(c).alias(f"__s_{c}") for c in (*keys, "part")], before)
    same = lambda columns, mark: [F.col(c).eqNullSafe(F.col(f"{mark}{c}")) for c in columns]
    per = per.join(sums, same([*keys, "part"], "__s_")).select(*keys, value, "part", "__n", "__before")
    inside = past(W.partitionBy(*keys, "part").orderBy(order(value)), "__n")
    ranks = per.select(*[F.col(c).alias(f"__{c}") for c in (*keys, value)], (F.col("__before") + inside + 1 + (F.col("__n") - 1) / 2.0).alias(out))
    return df.join(ranks, same([*keys, value], "__")).drop(*[f"__{c}" for c in (*keys, value)])


def combined_rank(df: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """rank_sum: sum over the metrics of ln(rank / (n + 1)); combined_rank: its rank, ties averaged."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    df = df.withColumn("rank_sum", F.round(sum((F.ln(average_rank(F.col(m), keys) / (n + 1)) for m in metrics), F.lit(0.0)), 9))
    return df.withColumn("combined_rank", average_rank(F.col("rank_sum"), keys, descending=False))


def latest_per_user(df: DataFrame, user: str, date: str, tie: str) -> DataFrame:
    """The newest row of each user; of equally new ones that with the largest tie column."""
    best = df.groupBy(user).agg(F.max_by(F.struct(*df.columns), F.struct(date, tie)).alias("r"))
    return best.select("r.*")


def global_ranking(df: DataFrame, metrics: list[str]) -> DataFrame:
    """user, min, mean and max of the bootstrap sums, and the second smallest bootstrap rank.

    df has user, tf, sample and bootstrap.  In each (tf, sample, bootstrap) a user's score is
    min(0.5, rank / (n + 1)) of the combined rank, and 0.5 if the user is absent.
    """
    board = ["tf", "sample", "bootstrap"]
    ranked = combined_rank(df, metrics, board)
    n = F.count(F.lit(1)).over(W.partitionBy(*board))
    scores = ranked.select("user", *board, F.least(F.lit(0.5), F.col("combined_rank") / (n + 1)).alias("s"))
    boards = df.select(*board).distinct().groupBy("bootstrap").agg(F.count("*").alias("boards"))
    # an absent user's 0.5 is added for each board of the bootstrap that the user has no score on
    have = scores.groupBy("user", "bootstrap").agg(F.sum("s").alias("s"), F.count("*").alias("k"))
    listed = boards.agg(F.collect_list(F.struct("bootstrap", "boards")).alias("b"))  # one row, as long as there are bootstraps
    every = df.select("user").distinct().crossJoin(F.broadcast(listed)).select("user", F.explode("b").alias("b")).select("user", "b.*")
    total = every.join(have, ["user", "bootstrap"], "left").select("user", "bootstrap", F.round(F.coalesce("s", F.lit(0.0)) + 0.5 * (F.col("boards") - F.coalesce("k", F.lit(0))), 9).alias("total"))
    placed = total.withColumn("rank", average_rank(F.col("total"), ["bootstrap"], descending=False))
    second = F.element_at(F.sort_array(F.collect_list("rank")), F.least(F.lit(2), F.count(F.lit(1)).cast("int")))
    return placed.groupBy("user").agg(F.min("total").alias("min_score"), F.avg("total").alias("mean_score"), F.max("total").alias("max_score"), second.alias("second_rank"))


def template_join(template: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each template region with its score; missing is 1 and the score 0.0 where there is none."""
    out = template.join(predictions, ["contig", "start", "end"], "left")
    return out.withColumn("missing", F.col("score").isNull().cast("int")).withColumn("score", F.coalesce("score", F.lit(0.0)))


def aligned_check(truth: DataFrame, submission: DataFrame) -> DataFrame:
    """One row of counts: regions of either side only, scores that are no numbers, labels that are not U, A or B."""
    both = truth.select("contig", "start", "end", "label").join(submission.select("contig", "start", "end", F.col("score").cast("string").alias("score")), ["contig", "start", "end"], "full")
    return both.agg(
        F.count_if(F.col("score").isNull()).alias("only_truth"), F.count_if(F.col("label").isNull()).alias("only_submission"),
        F.count_if(F.col("score").isNotNull() & F.col("score").try_cast("double").isNull()).alias("bad_scores"), F.count_if(F.col("label").isNotNull() & ~F.col("label").isin("U", "A", "B")).alias("bad_labels"),
    )


#: Fixed contigs of the ladder board, in its order.
LADDER = ("chr1", "chr21", "chr8")


def board_order(df: DataFrame, ladder: bool = True, contigs: tuple[str, ...] = LADDER) -> DataFrame:
    """Regions in board order: the ladder's contigs, or all, by contig, start, end; order is the place."""
    if ladder:
        df = df.filter(F.col("contig").isin(list(contigs)))
    return df.orderBy("contig", "start", "end")


def first_n(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """The first n rows of each key by an explicit order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
