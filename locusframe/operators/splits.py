"""Hold-outs, folds and seeded samples.

Choices are made by the first 32 bits of an MD5 of the key, which other engines have too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def key_hash(*parts: Column) -> Column:
    """0 to 2**32 - 1 from the parts joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def holdout(df: DataFrame, cells: list, contigs: list | None = None) -> DataFrame:
    """split: train if neither cell type nor contig is held out, test if both are, else null.

    Without contigs only the cell type counts.
    """
    cell = F.col("cell_type").isin(list(cells))
    contig = F.col("contig").isin(list(contigs)) if contigs else cell
    return df.withColumn("split", F.when(cell & contig, "test").when(~cell & ~contig, "train"))


def train_val(df: DataFrame, cells: list, contigs: list | None = None) -> DataFrame:
    """As holdout, with val for test; training rows that are ambiguous (label -1) belong to neither."""
    out = holdout(df, cells, contigs)
    return out.withColumn("split", F.when(F.col("split") == "test", "val").when((F.col("split") == "train") & (F.col("label") != -1), "train"))


def holdout_folds(df: DataFrame, n_cells: int = 1, n_contigs: int = 3, folds: int = 10, seed: int = 0) -> DataFrame:
    """fold, kind (cell_type or contig) and value: what each fold holds out, drawn by a seeded hash of the keys."""

    def some(kind: str, n: int) -> DataFrame:
        keys = df.select(F.col(kind).cast("string").alias("value")).distinct()
        dealt = keys.select("value", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
        dealt = dealt.withColumn("h", key_hash(F.lit(kind), F.col("value"), F.col("fold") + seed))
        least = dealt.groupBy("fold").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "value"))), 1, n).alias("v"))
        return least.select("fold", F.lit(kind).alias("kind"), F.explode("v.value").alias("value"))

    return some("cell_type", n_cells).unionByName(some("contig", n_contigs))


def with_holdouts(df: DataFrame, held: DataFrame) -> DataFrame:
    """Add train_folds and test_folds: a fold trains on rows of which neither key is held out, and tests those of which both are.

    held is that of holdout_folds: some values for each fold.
    """
    values: dict[int, dict[str, list[str]]] = {}
    for r in held.collect():
        values.setdefault(r["fold"], {"cell_type": [], "contig": []})[r["kind"]].append(r["value"])
    train, test = [], []
    for fold, some in sorted(values.items()):
        cell, contig = (F.coalesce(F.col(kind).cast("string").isin(some[kind]), F.lit(False)) for kind in ("cell_type", "contig"))
        train.append(F.when(~cell & ~contig, fold))
        test.append(F.when(cell & contig, fold))
    folds = lambda some: F.filter(F.array(*some), lambda x: x.isNotNull()) if some else F.array().cast("array<int>")
    return df.withColumns({"train_folds": folds(train), "test_folds": folds(test)})


def hash_fold(key: Column, k: int) -> Column:
    """A fold from 0 to k - 1 by a hash of the key; no row is left out."""
    return F.pmod(key_hash(key), F.lit(k)).cast("int")


def keep_by_hash(key: Column, rate: float, seed: int = 0) -> Column:
    """True for about rate of the keys; the same ones on each run."""
    return key_hash(F.lit(seed), key) < int(rate * 2**32)


def sample_negatives(df: DataFrame, rate: float, key: str, seed: int = 0) -> DataFrame:
    """All positives and about rate of the negatives, chosen by a seeded hash of the key; other labels go."""
    return df.filter((F.col("label") == 1) | ((F.col("label") == 0) & keep_by_hash(F.col(key), rate, seed)))


def sample_rows(df: DataFrame, rate: float, key: str, seed: int = 0) -> DataFrame:
    return df.filter(keep_by_hash(F.col(key), rate, seed))
