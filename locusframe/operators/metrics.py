"""Classification metrics by cumulative windows; equal scores are one threshold.

Rows are first summed by score, so a window runs over distinct scores.  To keep even those
out of one task, scores are cut into ranges of about equally many: each range is cumulated on its own
and the sums of the ranges above are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

RANGES = 64


def in_ranges(df: DataFrame, column: str) -> DataFrame:
    """Add part: which of RANGES ranges of about equally many rows a value lies in."""
    cuts = df.agg(F.percentile_approx(column, [i / RANGES for i in range(1, RANGES)], 1000).alias("__cuts"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("part", F.size(F.filter("__cuts", lambda c: c < F.col(column)))).drop("__cuts")  # one row
#: Keeps shares of empty classes finite.
_GUARD = 1e-6


def thresholds(df: DataFrame, keys: list[str] | None = None, label: str = "label", score: str = "score") -> DataFrame:
    """keys, score, tp and fp (at or above the score), p and n (of the whole key)."""
    keys = keys or []
    per = df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.count("*").alias("all"))
    per = in_ranges(per, "score")
    sums = per.groupBy(*keys, "part").agg(F.sum("pos").alias("part_pos"), F.sum("all").alias("part_all"))
    above = W.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    sums = sums.select(
        *keys, "part",
        F.coalesce(F.sum("part_pos").over(above), F.lit(0)).alias("pos_above"), F.coalesce(F.sum("part_all").over(above), F.lit(0)).alias("all_above"),
        F.sum("part_pos").over(whole).alias("p"), F.sum("part_all").over(whole).alias("total"),
    )
    inside = W.partitionBy(*keys, "part").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = per.join(sums, [*keys, "part"])
    tp = F.sum("pos").over(inside) + F.col("pos_above")
    seen = F.sum("all").over(inside) + F.col("all_above")
    return out.select(*keys, "part", "score", "pos", "all", tp.alias("tp"), (seen - tp).alias("fp"), "p", (F.col("total") - F.col("p")).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def curves(df: DataFrame, keys: list[str] | None = None, **columns: str) -> DataFrame:
    """thresholds with precision, recall, fpr and those of the threshold before."""
    t = thresholds(df, keys, **columns)
    prev_tp, prev_fp = F.col("tp") - F.col("pos"), F.col("fp") - (F.col("all") - F.col("pos"))
    return t.select(
        "*", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("p")).alias("recall"), _ratio(F.col("fp"), F.col("n")).alias("fpr"),
        _ratio(prev_tp, F.col("p")).alias("prev_recall"), _ratio(prev_fp, F.col("n")).alias("prev_fpr"),
        F.when(prev_tp + prev_fp == 0, F.lit(None)).otherwise(prev_tp / (prev_tp + prev_fp)).alias("prev_precision"),
    )


def recall_at(cut: float) -> Column:
    return F.coalesce(F.max(F.when(1 - F.col("precision") <= cut, F.col("recall"))), F.lit(0.0))


def au_roc() -> Column:
    return F.sum((F.col("fpr") - F.col("prev_fpr")) * (F.col("recall") + F.col("prev_recall")) / 2)


def au_prc() -> Column:
    """Area by trapezoids; the curve begins at the first threshold's precision."""
    return F.sum((F.col("recall") - F.col("prev_recall")) * (F.col("precision") + F.coalesce(F.col("prev_precision"), F.col("precision"))) / 2)


def average_precision() -> Column:
    return F.sum((F.col("recall") - F.col("prev_recall")) * F.col("precision"))


def _agg(df: DataFrame, keys: list[str] | None, *columns: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def binary_metrics(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return _agg(curves(df, keys), keys, au_prc().alias("auprc"), au_roc().alias("auroc"))


def recall_at_fdr(df: DataFrame, cuts: tuple[float, ...], keys: list[str] | None = None) -> DataFrame:
    """Largest recall among thresholds whose false discovery rate is at most the cut; 0 if there is none."""
    return _agg(curves(df, keys), keys, *[recall_at(c).alias(f"recall_at_{round(100 * c)}_fdr") for c in cuts])


def tagged_metrics(df: DataFrame, tag: str, cuts: tuple[float, ...] = (0.5, 0.25, 0.1, 0.05), keys: list[str] | None = None) -> DataFrame:
    values = [average_precision().alias(f"{tag}_ap"), au_roc().alias(f"{tag}_auroc"), *[recall_at(c).alias(f"{tag}_recall_at_{round(100 * c)}_fdr") for c in cuts]]
    return _agg(curves(df, keys), keys, *values)


def classification_report(df: DataFrame, keys: list[str] | None = None, cuts: tuple[float, ...] = (0.5, 0.25, 0.1, 0.05)) -> DataFrame:
    """Counts, areas, F1 and accuracies at score 0.5, and recalls; ambiguous labels are dropped."""
    df = df.filter("label > -0.5")
    c = curves(df, keys)
    over = F.col("score") > 0.5
    tp, pred = F.sum(F.when(over, F.col("pos")).otherwise(0)), F.sum(F.when(over, F.col("all")).otherwise(0))
    p, n = F.sum("pos"), F.sum(F.col("all") - F.col("pos"))
    tn = n - (pred - tp)
    return _agg(
        c, keys, tp.alias("tp"), p.alias("p"), tn.alias("tn"), n.alias("n"), au_roc().alias("auroc"), au_prc().alias("auprc"), _ratio(2.0 * tp, pred + p).alias("f1"),
        *[recall_at(x).alias(f"recall_at_{round(100 * x)}_fdr") for x in cuts],
        (tp / (p + _GUARD)).alias("positive_accuracy"), (tn / (n + _GUARD)).alias("negative_accuracy"), ((tp / (p + _GUARD) + tn / (n + _GUARD)) / 2).alias("balanced_accuracy"),
    )


def ids_dealt(df: DataFrame, folds: int) -> DataFrame:
    """Add fold: the place of a row among those of its label in order of id, modulo folds.

    Places are counted within ranges of ids, to which the rows of the ranges before are added.
    """
    df = in_ranges(df, "id")
    before = F.coalesce(F.sum("n").over(W.partitionBy("label").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = df.groupBy("label", "part").agg(F.count("*").alias("n")).select("label", "part", before.alias("before"))
    place = F.row_number().over(W.partitionBy("label", "part").orderBy("id")) - 1 + F.col("before")
    return df.join(F.broadcast(start), ["label", "part"]).withColumn("fold", place % folds).drop("part", "before")  # labels by ranges


def bootstrap_metrics(df: DataFrame, folds: int = 10, id_col: str = "id") -> DataFrame:
    """Average precision and auROC of each stratified fold: rows of a label are dealt out in order of id."""
    ids = df.select("label", F.col(id_col).alias("id"), "score")
    return _agg(curves(ids_dealt(ids, folds), ["fold"]), ["fold"], average_precision().alias("ap"), au_roc().alias("auroc"))


def class_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def missed_counts(df: DataFrame) -> DataFrame:
    """False negatives and positives of label and prediction."""
    return df.agg(F.count_if((F.col("label") == 1) & (F.col("prediction") == 0)).alias("false_negatives"), F.count_if((F.col("label") == 0) & (F.col("prediction") == 1)).alias("false_positives"))


def minmax_scale(df: DataFrame, column: str, out: str = "scaled") -> DataFrame:
    """(x - min) / (max - min); 0.0 if all are equal."""
    bounds = df.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    x = F.when(F.col("__high") == F.col("__low"), 0.0).otherwise((F.col(column) - F.col("__low")) / (F.col("__high") - F.col("__low")))
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, x).drop("__low", "__high")  # one row


def column_distribution(df: DataFrame, vector: str, gaussian: bool = True) -> DataFrame:
    """Sum of the column means of a vector column, and of the column variances."""
    per = df.select(F.posexplode(vector).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    return per.agg(F.sum("m").alias("mean"), *([F.sum("s").alias("variance")] if gaussian else []))


def synthetic_scores(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """A seeded score by label: U in [0, .8), A in [.5, .9), B in [.7, 1)."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_003)) / 1_000_003.0
    low, wide = F.when(F.col("label") == 0, 0.0).when(F.col("label") == -1, 0.5).otherwise(0.7), F.when(F.col("label") == 0, 0.8).when(F.col("label") == -1, 0.4).otherwise(0.3)
    return df.withColumn("score", low + wide * u)
