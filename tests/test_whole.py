"""Whole inputs: nothing after a prefix or outside a fixed range is left out."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe import catalog
from locusframe.functions import sequence as S
from locusframe.plans import model_queries, views as V


@pytest.fixture()
def documents(spark, tmp_path):
    def write(texts):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
        return f"file://{tmp_path}"

    return write


def test_reference_has_no_cap(spark, documents):
    d = documents(["a" * 2_000_005, None, "abc"])
    assert {r.contig: r.length for r in catalog.QUERIES["scan_reference"](spark, d).collect()} == {"0": 2_000_005, "2": 3}


def test_whole_texts_are_read(spark, documents):
    d = documents(["ab" * 225, "a" * 200, "", None])
    counts = catalog.QUERIES["kmer_count_whole"](spark, d).groupBy("id").agg(F.sum("n").alias("n")).collect()
    assert {r.id: r.n for r in counts} == {0: 447, 1: 197}
    windows = V.sequence_windows(spark, d).orderBy("id", "window").collect()
    assert [(r.id, r.window, len(r.sequence)) for r in windows] == [(0, 0, 200), (0, 1, 200), (0, 2, 50), (1, 0, 200)]
    assert catalog.QUERIES["featurize_sequence_phase"](spark, d).count() == 4


@pytest.mark.parametrize("n", [0, 1, 3, 4, 255, 256, 257, 259, 260, 600])
def test_cuts_across_pieces(spark, n):
    text = "".join("ACGT"[i * i % 7 % 4] for i in range(n))
    got = spark.createDataFrame([(text,)], "s string").select(S.cuts_of(F.col("s"), 4).alias("c"), S.bases(F.col("s")).alias("b")).first()
    assert got.c == [text[i : i + 4] for i in range(n - 3)] and got.b == list(text)


DATA = "/root/testdata/sf0.001"


def test_datasets_have_all_windows(spark):
    every = V.windows(spark, DATA).count()
    out = catalog.QUERIES["job_dataset_tf_whole"](spark, DATA).cache()
    assert out.count() == every == catalog.QUERIES["job_dataset_test_whole"](spark, DATA).count() / 2
    late = out.filter("start >= 2000").agg(F.sum("reads").alias("reads"), F.sum(F.col("c0") + F.col("c1") + F.col("c2")).alias("by_type")).first()
    assert late.reads == late.by_type > 0


def test_motifs_of_the_whole_table(spark, documents):
    d = documents([" " * 5 + "acdbac", "a"])
    spark.createDataFrame([(i, 900.0 + i * i % 37) for i in range(12 * 5 + 7)], "p_partkey long, p_retailprice double").write.parquet(f"{d}/part.parquet")
    assert {r.motif_id for r in catalog.QUERIES["scan_pwms_whole"](spark, d).collect()} == {0, 1, 3, 4}
    assert {(r.id, r.motif_id) for r in catalog.QUERIES["pwm_score_all"](spark, d).collect()} == {(0, m) for m in (0, 1, 3, 4)}


def test_near_kmers_of_all_compositions(spark, documents):
    text = "acdbbdca acddb" * 30
    folded = text.translate(str.maketrans("abcd ", "ATCGN"))
    kmers = [k for i in range(len(text) - 3) if "N" not in (k := folded[i : i + 4])]
    want = {}
    for a, c, g in itertools.product(range(5), repeat=3):
        if a + c + g <= 4:
            other = Counter(dict(zip("ACGT", (a, c, g, 4 - a - c - g), strict=True)))
            if n := sum((Counter(k) - other).total() <= 1 for k in kmers):
                want[a, c, g, 4 - a - c - g] = n
    got = catalog.QUERIES["kmer_counts_near"](spark, documents([text])).collect()
    assert {(r.a, r.c, r.g, r.t): r.n for r in got} == want


def test_ridge_of_all_features(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(150, 64)), rng.integers(0, 3, 150)
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["ridge_fit_whole"](spark, f"file://{tmp_path}").orderBy("place").toPandas()["w"]
    assert np.allclose(got, np.linalg.solve(x.T @ x + 0.5 * np.eye(64), x.T @ (label == 0)))


def test_onehot_job_uses_every_window(spark, tmp_path):
    spark.createDataFrame([(0, "ac" * 225, "en"), (1, "acgt", "de")], "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    features = model_queries._onehot_features(spark, f"file://{tmp_path}")
    rows = features.select("id", F.size("features").alias("size"), F.aggregate("features", F.lit(0.0), lambda a, v: a + v).alias("ones")).collect()
    assert sorted(map(tuple, rows)) == [(0, 802, 51.0), (0, 802, 201.0), (0, 802, 201.0), (1, 802, 5.0)]
