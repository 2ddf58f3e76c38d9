"""Fixed acceptance values of the operators, on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import labels as L, sequence as S
from locusframe.operators import coverage as C, features as X, intervals as I, metrics as M, models as O, ranking as R, sequences as Q, splits as P


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def test_windows_of_three_regions(spark):
    df = spark.createDataFrame([("chr1", 190, 210, "c", 1), ("chr1", 140, 260, "c", 2), ("chr1", 160, 190, "c", 3)], "contig string, start long, end long, cell_type string, id long")
    lengths = spark.createDataFrame([("chr1", 10_000_000)], "contig string, length long")
    out = I.window_collect(df, lengths, ["cell_type"], "id").orderBy("win_start")
    assert [(r.win_start, r.n) for r in out.collect()] == [(0, 3), (50, 3), (100, 3), (150, 3), (200, 2), (250, 1)]


@pytest.mark.parametrize("strand, expected", [("+", [10, 20]), ("-", [9, 19])])
def test_cuts(spark, strand, expected):
    df = spark.createDataFrame([("chr1", 10, 20, strand)], "contig string, start long, end long, strand string")
    assert sorted(r.start for r in C.cuts(df).collect()) == expected


def test_footprint_of_ones(spark):
    out = one(spark, S.footprint(F.array(*[F.lit(1.0)] * 8)))
    assert out == [8.0] + [0.5] * 7


def test_cut_offsets(spark):
    cut = spark.createDataFrame([("chr6", 32783380, 32783381, "+")], "contig string, start long, end long, strand string")
    out = C.pileup(C.cut_windows(cut).withColumn("one", F.lit(1)), ["contig", "win_start"], "one")
    found = {r.win_start: r.dnase for r in out.collect()}
    assert found[32783200][180] == 1.0 and found[32783350][30] == 1.0
    assert sum(found[32783200]) == 1.0 and len(found[32783200]) == 400


def test_one_hot_with_signal(spark):
    out = one(spark, S.one_hot_signal(F.lit("ATCG"), F.array(*[F.lit(v) for v in (0.0, 9.0, 10.0, 3.0)])))
    assert len(out) == 16 and (out[0], out[5], out[10], out[15]) == (1.0, 10.0, 11.0, 4.0) and sum(out) == 26.0


def test_ngrams_and_decode(spark):
    df = spark.createDataFrame([("ATCG",)], "s string").select(S.once(S.one_hot(F.col("s"))).alias("v")).select(S.once(S.ngrams(F.col("v"), 2)).alias("g"))
    decoded = df.select(F.explode("g").alias("v")).select(S.once(F.col("v")).alias("v")).select(S.one_hot_text(F.col("v")))
    assert [r[0] for r in decoded.collect()] == ["AT", "TC", "CG"]
    assert one(spark, S.one_hot_text(S.one_hot(F.lit("ANT")))) == "ANT"
    assert one(spark, S.one_hot(F.lit(""))) == []


def test_kernel_is_approximated(spark):
    rng = np.random.default_rng(0)
    a, b = ("".join(rng.choice(list("ACGT"), 200)) for _ in range(2))
    b = a[:150] + b[150:]
    df = spark.createDataFrame([(0, a), (1, b)], "id long, sequence string")
    filters = X.gaussian_filters(4000, 32, gamma=1.0, seed=1)
    phase = np.random.default_rng(2).uniform(0, 2 * np.pi, 4000)
    f = {r.id: np.array(r.features) for r in X.featurize_sequence(df, filters, phase).collect()}
    approx = f[0] @ f[1] / np.sqrt((f[0] @ f[0]) * (f[1] @ f[1]))
    hot = {i: np.array([[c == x for x in "ATCG"] for c in s], float).ravel() for i, s in enumerate((a, b))}
    grams = {i: np.lib.stride_tricks.sliding_window_view(v, 32)[::4] for i, v in hot.items()}

    def kernel(p, q):
        d = (p**2).sum(1)[:, None] + (q**2).sum(1)[None] - 2 * p @ q.T
        return np.exp(-d / 2).sum()

    exact = kernel(grams[0], grams[1]) / np.sqrt(kernel(grams[0], grams[0]) * kernel(grams[1], grams[1]))
    assert abs(approx - exact) < 0.03


def test_fast_features_have_the_right_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 20)) * 0.3
    z = X.fast_products(x, 4096, 1.0, 5)
    phase = np.random.default_rng(1).uniform(0, 2 * np.pi, 4096)
    f = np.cos(z + phase) * np.sqrt(2 / 4096)
    assert abs(f[0] @ f[1] - np.exp(-((x[0] - x[1]) ** 2).sum() / 2)) < 0.06


@pytest.mark.parametrize("k", [2, 3])
def test_all_kmers(spark, k):
    assert Q.kmer_table(k, spark).select("kmer").distinct().count() == 4**k


@pytest.mark.parametrize("sequence, expected", [("AAAAAAAAATAAAAAA", 9), ("AAAAAAAAATTAAAAA", 3)])
def test_near_kmers(spark, sequence, expected):
    df = spark.createDataFrame([(1, sequence)], "id long, sequence string")
    assert Q.kmer_count_near(df, 8, 1, "A" * 8).first().n == expected


def test_kmers_drop_other_letters(spark):
    df = spark.createDataFrame([(1, "AANAA"), (2, None), (3, "")], "id long, sequence string")
    assert rows(Q.kmer_counts(df, 2)) == [(1, "AA", 2)]


def test_kmer_index(spark):
    df = Q.kmer_table(3, spark).withColumn("again", S.kmer_index(F.col("kmer"), 3))
    assert df.filter("again <> kmer_index").count() == 0


def test_shuffle_keeps_pairs():
    rng = np.random.default_rng(0)
    for s in ("AAACCC", "ACGTTGCAACGTAGCTAGCATCG", "AC", "", "AAAA"):
        t = Q.shuffled(s, rng)
        assert sorted(a + b for a, b in zip(s, s[1:], strict=False)) == sorted(a + b for a, b in zip(t, t[1:], strict=False))


def test_extract_sequences(spark):
    chunks = Q.chunked(spark.createDataFrame([("x", "acgt" * 50)], "contig string, seq string"))
    regions = spark.createDataFrame([("x", 60, 70), ("x", 60, 70), ("x", 198, 220), ("y", 0, 5)], "contig string, start long, end long")
    out = sorted((r.contig, r.start, r.sequence) for r in Q.extract_sequences(regions, chunks).collect())
    full = ("ACGT" * 50)
    assert out == [("x", 60, full[60:70]), ("x", 60, full[60:70]), ("x", 198, full[198:]), ("y", 0, "")]


def test_overlap_join_equals_the_plain_condition(spark):
    rng = np.random.default_rng(3)
    make = lambda n: [(i, "c", int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(0, 9000, n), rng.integers(1, 3000, n), strict=True))]
    a, b = make(150), make(150)
    schema = "id long, contig string, start long, end long"
    got = sorted(rows(I.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).select("id", "r_id")))
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[2] < y[3] and y[2] < x[3])
    empty = spark.createDataFrame([], schema)
    assert I.overlap_join(spark.createDataFrame(a, schema), empty, how="left").filter("r_id is null").count() == 150


def test_overlap_join_plans_no_nested_loop(spark):
    df = spark.createDataFrame([(1, "c", 1, 2)], "id long, contig string, start long, end long")
    plan = I.overlap_join(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_labels(spark):
    df = spark.createDataFrame([("A",), ("U",), ("B",), (None,)], "t string")
    assert [r[0] for r in df.select(L.label_encode(F.col("t"))).collect()] == [-1, 0, 1, None]
    with pytest.raises(Exception, match="not a label"):
        spark.createDataFrame([("Q",)], "t string").select(L.label_encode(F.col("t"))).collect()


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)], "label int, score double")
    assert M.tagged_metrics(df, "t").first().t_ap == pytest.approx(0.8333, abs=1e-4)
    assert M.binary_metrics(df).first().auprc == pytest.approx(0.7917, abs=1e-4)
    assert M.binary_metrics(df).first().auroc == pytest.approx(0.75)
    assert M.recall_at_fdr(df, (0.0, 0.5)).first()[:] == (0.5, 1.0)


def test_recall_at_fdr_with_ties(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "label int, score double")
    for cut in (0.5, 0.45, 0.4):
        best = max([0.0] + [y[s >= t].sum() / y.sum() for t in set(s) if 1 - y[s >= t].mean() <= cut])
        assert M.recall_at_fdr(df, (cut,)).first()[0] == pytest.approx(best)


def test_minmax_of_equal_values(spark):
    assert [r.scaled for r in M.minmax_scale(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").collect()] == [0.0, 0.0]


def test_average_rank(spark):
    df = spark.createDataFrame([(3,), (2,), (2,)], "x int").withColumn("r", R.average_rank(F.col("x"), [F.lit(1)]))
    assert sorted(r.r for r in df.collect()) == [1.0, 2.5, 2.5]


def test_holdout(spark):
    keys = [(f"chr{c}", f"t{t}", i) for c in range(1, 24) for t in range(4) for i in range(2)]
    df = P.holdout(spark.createDataFrame(keys, "contig string, cell_type string, i int"), ["t1"], ["chr5"])
    n = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert n["test"] == 2 and n["train"] == 22 * 3 * 2 and sum(n.values()) == len(keys)


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 4)), rng.normal(size=60)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "features array<double>, label double")
    assert np.allclose(O.ridge_fit(df, 2.0), np.linalg.solve(x.T @ x + 2 * np.eye(4), x.T @ y))


def test_near_positives_by_hand(spark):
    df = spark.createDataFrame([(0, "c", 0, 200, 1), (1, "c", 500, 700, 0), (2, "c", 150, 350, 0), (3, "c", 5000, 5200, 0), (4, "c", 900, 1100, -1)], "id long, contig string, start long, end long, label int")
    assert sorted(r.id for r in I.near_positives(df, []).collect()) == [0, 1]


def test_contig_table_and_names(spark):
    df = spark.createDataFrame([("/a/DNASE.A549.x.narrowPeak/part-0.csv",), ("/a/L.TF.CELL.tab.gz",)], "p string")
    assert [r[0] for r in df.select(L.name_part(F.col("p"), 1)).collect()] == ["A549", "TF"]
    assert [r[0] and tuple(r[0]) for r in df.select(L.submission_name(F.col("p"))).collect()] == [None, ("L", "TF", "CELL")]


def test_motif_centers_agree_by_array_and_by_join(spark, monkeypatch):
    from locusframe.operators import sequences as Q

    pwms = [(m, f"t{m % 2}", pos, b, p) for m in range(3) for pos in range(3 + m) for b, p in zip("ACGT", [(0.1, 0.2, 0.3, 0.4), (0.7, 0.1, 0.1, 0.1), (0.25, 0.25, 0.25, 0.25)][(m + pos) % 3], strict=True)]
    motifs = Q.motif_arrays(spark.createDataFrame(pwms, "motif_id int, tf string, pos int, base string, p double"))
    rows = [(i, f"t{i % 3}", s) for i, s in enumerate(["ACGTACGTTTAGACC", "NNNNNNN", "AC", "", None, "ACGNACGTAé", "TTTTTTTTTT", "T" * 600 + "ACGTA"])]
    windows = spark.createDataFrame(rows, "id long, tf string, sequence string")
    one = sorted(map(str, Q.best_motif_center(windows, motifs).collect()))
    monkeypatch.setattr(Q, "MOTIFS", 0)
    assert sorted(map(str, Q.best_motif_center(windows, motifs).collect())) == one
    assert Q.best_motif_center(windows.limit(0), motifs).count() == 0


def test_gram_in_several_pieces(spark, monkeypatch):
    import numpy as np

    from locusframe.operators import models as O

    monkeypatch.setattr(O, "PACK", 7)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 6)), rng.normal(size=50)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)] + [(None, 1.0)], "features array<double>, label double").repartition(4)
    xx, xy, n = O.gram(df, intercept=True)
    full = np.column_stack([x, np.ones(50)])
    assert n == 50 and np.allclose(xx, full.T @ full) and np.allclose(xy, full.T @ y)
    assert O.gram(df.limit(0))[2] == 0


def test_names_of_paths_without_a_pattern(spark):
    paths = ["/a/expression.A549.tsv/part-0.csv", "expression.A549.tsv", "part-0.x", "/part-0.x", "/a/part-x.tsv/part-0.csv", "/a.b/", "/a/b.part-c.d"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(L.name_part(F.col("p"), 0).alias("a"), L.name_part(F.col("p"), 1).alias("b"))
    assert [tuple(r) for r in df.collect()] == [("expression", "A549"), ("expression", "A549"), ("part-0", "x"), ("part-0", "x"), ("part-x", "tsv"), ("", None), ("b", "part-c")]
    assert "regexp" not in df._jdf.queryExecution().toString()
