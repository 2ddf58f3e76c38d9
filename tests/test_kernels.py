"""Array kernels against plain loops over letters and numbers."""

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusframe.operators import features as X, kernels as K, sequences as Q

TEXTS = [None, "", "A", "AC", "ACGTNACGT", "NNNN", "acgt", "ACGé日ACGT", "GATTACA" * 40, "ACGT" * 3, "ACGT" * 3, "T" * 5000]


@pytest.fixture()
def frame(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "id long, sequence string, n string").repartition(2)


def kmers(text, k):
    return Counter(w for i in range(len(text or "") - k + 1) if not set(w := text[i : i + k]) - set("ACGT"))


@pytest.mark.parametrize("k", [1, 3, 4, 9, 31])
def test_kmers(spark, frame, monkeypatch, k):
    want = {(i, w): n for i, t in enumerate(TEXTS) for w, n in kmers(t, k).items()}
    counted = Q.kmer_counts(frame, k)
    assert {(r.id, r.kmer): r.n for r in counted.collect()} == want and counted.count() == len(want)
    assert "Exchange" not in Q.kmer_counts(spark.createDataFrame([(1, "A")], "id long, sequence string"), k)._jdf.queryExecution().executedPlan().toString()
    totals = {r.kmer: (r.sequences, r.n) for r in Q.kmer_totals(frame, k).collect()}
    assert totals == {w: (sum(x == w for _, x in want), sum(n for (_, x), n in want.items() if x == w)) for w in {w for _, w in want}}


def test_near_kmers(frame):
    k, distance = 4, 1
    for of in ("AACT", "GGGG"):
        near = lambda w, of=of: (Counter(w) - Counter(of)).total() <= distance
        want = {i: n for i, t in enumerate(TEXTS) if (n := sum(c for w, c in kmers(t, k).items() if near(w)))}
        assert {r.id: r.n for r in Q.kmer_count_near(frame, k, distance, of).collect()} == want
        every = Q.kmer_counts_near(frame, k, distance).filter(" AND ".join(f"{b.lower()} = {of.count(b)}" for b in "ACGT"))
        assert {r.id: r.n for r in every.collect()} == want


def one_hot(text):
    return np.array([[c == b for b in "ATCG"] for c in text], float).ravel()


def plain(x, filters, alphabet, phase=None):
    z = np.zeros(len(filters))
    for i in range(0, len(x) - filters.shape[1] + 1, alphabet):
        z += np.cos(filters @ x[i : i + filters.shape[1]] + (0 if phase is None else phase))
    return z * np.sqrt(2 / len(filters))


@pytest.mark.parametrize(("count", "ngram", "block"), [(4, 3, 1 << 21), (5, 7, 64), (9, 1, 100), (3, 12, 1 << 21)])
def test_features_of_letters(spark, frame, monkeypatch, count, ngram, block):
    rng = np.random.default_rng(count)
    filters, phase = rng.normal(size=(count, 4 * ngram)), rng.uniform(0, 6, count)
    texts = [t or "" for t in TEXTS]
    code = K.letters(pa.array(texts), K.code_table("ATCG"))
    monkeypatch.setattr(K, "BLOCK", block)
    got = K.BaseFilters(filters, np.cos, phase).features(*code)
    assert np.allclose(got, [plain(one_hot(t), filters, 4, phase) for t in texts])
    out = {r.id: r.features for r in X.featurize_sequence(frame, filters, phase).collect()}
    assert out[0] is None and all(np.allclose(out[i], got[i]) for i in range(1, len(texts)))
    hot = K.one_hot_column(frame, "ATCG", out="n")
    assert {r.id: r.n for r in hot.collect()} == {i: None if t is None else one_hot(t).tolist() for i, t in enumerate(TEXTS)}
    dense = {r.id: r.features for r in X.random_features(hot, "n", filters, phase=phase).collect()}
    assert dense[0] is None and all(np.allclose(dense[i], got[i]) for i in range(1, len(texts)))


def test_structured_filters_multiplied_out_are_the_same(spark, frame, monkeypatch):
    fast = X.FastFilters(28, 40, 0.7, 3)
    rows = np.random.default_rng(1).normal(size=(6, 28))
    assert np.allclose(fast.products(rows), rows @ fast.matrix(28).T)
    some = {r.id: r.features for r in X.featurize_sequence_phase(frame, 6, 4).collect()}
    phase = np.random.default_rng(1).uniform(0, 2 * np.pi, 6)
    for i, t in enumerate(TEXTS[1:], 1):
        assert np.allclose(some[i], plain(one_hot(t), X.FastFilters(16, 6, 1.0, 0).matrix(16), 4, phase))


def test_features_of_signals(spark):
    rng = np.random.default_rng(7)
    rows = [(0, "ACGTACGTNA", rng.integers(0, 3, 20).astype(float).tolist()), (1, "AC", None), (2, "GGGTTTCCCA", []), (3, "ACGTACGTAC", rng.integers(0, 2, 20).astype(float).tolist())]
    df = spark.createDataFrame(rows, "id long, sequence string, dnase array<double>")
    filters, own, raw = rng.normal(size=(3, 12)), rng.normal(size=(3, 4)), rng.normal(size=(3, 9))
    filled = [(t, np.array(s or [0.0] * 20)) for _, t, s in rows]
    feats = lambda out: [r.features for r in out.orderBy("id").collect()]
    both = [np.concatenate([plain(one_hot(t), filters, 4), plain(s[:10], own, 1), plain(s[10:], own, 1)]) for t, s in filled]
    assert np.allclose(feats(X.featurize_signal(df, filters, own, window=10)), both)
    raised = [plain(one_hot(t) * np.repeat(1 + np.resize(s[:10], max(len(t), 10))[: len(t)], 4), filters, 4) for t, s in filled]
    assert np.allclose(feats(X.featurize_signal(df, filters, window=10)), raised)
    assert np.allclose(feats(X.featurize_concat_raw(df, raw, window=10)), [plain(np.concatenate([one_hot(t), s]), raw, 1) for t, s in filled])
    banks = [X.gaussian_filters(3, w, seed=i) for i, w in enumerate((5, 2))]
    many = [np.concatenate([plain(one_hot(t), filters, 4), *(np.prod([plain(x, b, 1) for b in banks], axis=0) for x in (s[:10], s[10:]))]) for t, s in filled]
    assert np.allclose(feats(X.featurize_multiscale_signal(df, filters, widths=(5, 2), window=10)), many)


def test_compositions_are_all():
    assert sorted(map(tuple, Q._compositions(3).tolist())) == sorted(x for x in itertools.product(range(4), repeat=4) if sum(x) == 3)


def test_kmers_of_a_column_that_is_called_like_the_result(spark):
    df = spark.createDataFrame([("a", "ACGT")], "kmer string, n string")
    assert [tuple(r) for r in Q.kmer_counts(df, 4, id_col="kmer", seq_col="n").select(F.col("id"), "kmer", "n").collect()] == [("a", "ACGT", 1)]


def motif_scores(text, probs):
    at = {b: i for i, b in enumerate("ACGT")}
    return [np.prod([row[at[c]] if c in at else 0.0 for c, row in zip(text[i:], probs, strict=False)]) for i in range(len(text) - len(probs) + 1)]


@pytest.mark.parametrize("wave", [2000, 2])
def test_motifs_of_several_lengths(spark, frame, monkeypatch, wave):
    monkeypatch.setattr(Q, "MOTIFS", wave)
    rng = np.random.default_rng(4)
    probs = {i: rng.dirichlet(np.full(4, 0.4), n) for i, n in enumerate((1, 3, 3, 8, 12, 4))}
    motifs = spark.createDataFrame([(i, "t", len(p), p.ravel().tolist()) for i, p in probs.items()], "motif_id int, tf string, len int, probs array<double>")
    got = {(r.id, r.motif_id): r.total for r in Q.pwm_totals(frame, motifs).collect()}
    want = {(i, m): sum(s) for i, t in enumerate(TEXTS) for m, p in probs.items() if (s := motif_scores(t or "", p))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    least = 0.05
    hits = {(r.id, r.motif_id, r.place): r.prob for r in Q.motif_hits(frame, motifs, least).collect()}
    every = {(i, m, a): p for i, t in enumerate(TEXTS) for m, x in probs.items() for a, p in enumerate(motif_scores(t or "", x)) if p >= least}
    assert hits.keys() == every.keys() and all(hits[k] == pytest.approx(every[k]) for k in every) and len(every) > 100
    with pytest.raises(ValueError):
        Q.motif_hits(frame, motifs, 0.0)


def test_totals_of_equal_motifs_are_stored_as_runs(spark, tmp_path):
    """Every sequence meets every motif, but files do not hold the total of equal motifs once for each."""
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("ACGT"), 60)) for _ in range(300)]
    kinds, of = rng.dirichlet(np.full(4, 0.4), (30, 3)), rng.permutation(np.arange(3000) % 30)
    motifs = spark.createDataFrame([(i, "t", 3, kinds[k].ravel().tolist()) for i, k in enumerate(of.tolist())], "motif_id int, tf string, len int, probs array<double>")
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, sequence string").coalesce(1)
    Q.pwm_totals(frame, motifs).write.parquet(f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out").toPandas()
    assert len(got) == len(got.drop_duplicates(["id", "motif_id"])) == 300 * 3000
    want = np.array([[sum(motif_scores(t, k)) for k in kinds] for t in texts])
    assert np.allclose(got["total"], want[got["id"], of[got["motif_id"]]])
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.7 * len(got)


def test_hits_are_stored_as_runs(spark, tmp_path):
    """Places of equal letters have the same motifs: files do not hold the number of each for each place."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACGT"), 500)) for _ in range(20)]
    probs = rng.dirichlet(np.full(4, 0.3), (2000, 3))
    motifs = spark.createDataFrame([(i, "t", 3, p.ravel().tolist()) for i, p in enumerate(probs)], "motif_id int, tf string, len int, probs array<double>")
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, sequence string").coalesce(1)
    Q.motif_hits(frame, motifs, 0.1).write.parquet(f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out").toPandas()
    scores = np.stack([np.prod([p[j][[["ACGT".index(c) for c in t[j : len(t) - 2 + j]] for t in texts]] for j in range(3)], axis=0) for p in probs])
    want = np.argwhere(scores >= 0.1)
    assert sorted(map(tuple, got[["motif_id", "id", "place"]].to_numpy().tolist())) == list(map(tuple, want.tolist())) and len(want) > 500_000
    assert np.allclose(got["prob"], scores[got["motif_id"], got["id"], got["place"]])
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.8 * len(got)


def test_rows_of_motifs_are_made_from_lists(spark, frame):
    """Python gives lists whose products are the rows, not each row of texts times motifs."""
    stack = Q.MotifStack([(i, [0.7, 0.1, 0.1, 0.1] * 3) for i in range(3000)])
    code, at = K.letters(pa.array(["A" * 1000, "CA", "AAA"]), K.code_table("ACGT"))
    lists = list(stack.products(code, at, 0.3))
    assert sum((np.diff(w) * np.diff(of)).sum() for _, _, w, _, _, of in lists) == 3000 * 999
    assert sum(len(x[0]) + len(x[3]) for x in lists) < 3000 * 999 / 100
    motifs = spark.createDataFrame([(0, "t", 1, [0.7, 0.1, 0.1, 0.1])], "motif_id int, tf string, len int, probs array<double>")
    for rows in (Q.pwm_totals(frame, motifs), Q.motif_hits(frame, motifs, 0.1)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert -1 < plan.find("Generate") < plan.find("MapInArrow")


def test_totals_are_rounded_as_in_sql(spark, frame):
    motifs = spark.createDataFrame([(0, "t", 1, [0.125, 0.375, 0.123456, 0.376544]), (1, "t", 1, [0.000005, 0.999985, 0.00001, 0.0])], "motif_id int, tf string, len int, probs array<double>")
    totals = lambda **by: {(r.id, r.motif_id): r.total for r in Q.pwm_totals(frame, motifs, **by).collect()}
    exact, rounded = totals(), totals(digits=5)
    assert exact.keys() == rounded.keys() and len(exact) > 4 and all(rounded[k] == pytest.approx(exact[k], abs=5.1e-6) and rounded[k] == float(f"{rounded[k]:.5f}") for k in exact)


@pytest.mark.parametrize("wave", [50_000, 5])
def test_best_motif_of_many(spark, frame, monkeypatch, wave):
    """Motifs do not meet the texts one by one; long ones are compared between waves."""
    monkeypatch.setattr(Q, "MOTIFS", wave)
    monkeypatch.setattr(Q, "_best_by_join", lambda *a: pytest.fail("motifs are joined with the texts"))
    rng = np.random.default_rng(6)
    lengths = [3] * 60 + [1, 4, 5, 6, 6, 7, 9, 12, 6, 7, 8]
    probs = {i: np.round(rng.dirichlet(np.full(4, 0.5), n), 1) for i, n in enumerate(lengths)}
    motifs = spark.createDataFrame([(i, "t" if i % 2 else "u", len(p), p.ravel().tolist()) for i, p in probs.items()], "motif_id int, tf string, len int, probs array<double>")
    windows = frame.unionByName(frame).selectExpr("id", "CASE WHEN id % 3 = 2 THEN 'v' WHEN id % 3 = 1 THEN 'u' ELSE 't' END AS tf", "sequence")
    want = []
    for i, t in enumerate(TEXTS):
        hits = [(round(p, 12), -a, -m, p) for m, x in probs.items() if i % 3 == (0 if m % 2 else 1) for a, p in enumerate(motif_scores(t or "", x))]
        top = max(hits, default=None)
        want += [(i, None if t is None else len(t) // 2, 0.0) if top is None else (i, -top[1] + len(probs[-top[2]]) // 2, round(top[3], 9))] * 2
    got = [(r.id, r.center, round(r.prob, 9)) for r in Q.best_motif_center(windows, motifs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_short_hits_are_looked_up(monkeypatch):
    """Many motifs cost the texts no product for each place and motif."""
    probs = np.tile([0.7, 0.1, 0.1, 0.1] + [0.25] * 4, (3000, 1))
    stack = Q.MotifStack(list(enumerate(probs)))
    monkeypatch.setattr(K, "BLOCK", 64)
    code, at = K.letters(pa.array(["A" * 2000 + "CA", "C" * 500_000]), K.code_table("ACGT"))
    sizes = [(len(place), place.max()) for _, _, place, p in stack.hits(code, at, 0.17) if (p == 0.7 * 0.25).all()]
    assert sum(n for n, _ in sizes) == 3000 * 2000 and max(x for _, x in sizes) == 1999


def test_sums_of_lists(spark):
    df = spark.createDataFrame([(0, [1.5, 2.0, -1.0]), (1, []), (2, None), (3, [4.0])], "id long, v array<double>")
    assert sorted(tuple(r) for r in K.list_sums(df, "v").collect()) == [(0, 2.5, 2.5), (1, 0.0, 0.0), (2, None, None), (3, 4.0, 4.0)]


def test_one_hot_kernels_equal_the_column_functions(spark, frame):
    """The kernels take whole batches; the column functions state what they give."""
    from locusframe.functions import sequence as S

    hot = K.one_hot_column(frame, "ATCG").select("id", "v").cache()
    by_id = lambda df, c: {r["id"]: r[c] for r in df.collect()}
    assert by_id(K.text_of_one_hot(hot, "ATCG"), "sequence") == by_id(hot.filter("v IS NOT NULL").select("id", S.one_hot_text(F.col("v")).alias("s")).unionByName(hot.filter("v IS NULL").selectExpr("id", "CAST(NULL AS string) s")), "s")
    full = hot.filter("v IS NOT NULL")
    assert by_id(K.gram_counts(full, 8), "grams") == by_id(full.select("id", F.size(S.ngrams(F.col("v"), 8)).alias("g")), "g")
    norms, want = by_id(K.gram_norms(full, 3), "norm"), by_id(full.filter("size(v) >= 12").select("id", S.conv_norm(S.ngrams(F.col("v"), 3)).alias("g")), "g")
    assert all(norms[i] == pytest.approx(w) for i, w in want.items()) and len(want) > 2
    raised = frame.filter("sequence IS NOT NULL").withColumn("signal", F.array(F.lit(2.5), F.lit(None).cast("double"), F.lit(1.0)))
    assert by_id(K.one_hot_signals(raised, "ATCG"), "v") == by_id(raised.select("id", S.one_hot_signal(F.col("sequence"), F.col("signal")).alias("v")), "v")


def test_gram_matrix_is_made_and_its_rows_are_counted(spark, frame, monkeypatch):
    """Each row of the matrix is there with its numbers, in blocks that end within a vector; the counts are those of its rows."""
    from locusframe.functions import sequence as S

    monkeypatch.setattr(K, "BLOCK", 100)
    hot = K.one_hot_column(frame, "ATCG").select("id", "v").filter("v IS NOT NULL").orderBy("id").cache()
    want = [[tuple(g) for g in r.g] for r in hot.select("id", S.ngrams(F.col("v"), 3).alias("g")).orderBy("id").collect()]
    flat, at = K.flat_lists(pa.array([r.v for r in hot.orderBy("id").collect()], pa.list_(pa.float64())))
    got = [[] for _ in want]
    for vector, matrix in K.gram_matrices(flat, at, 3):
        assert matrix.size <= 100
        for i, row in zip(vector, matrix, strict=True):
            got[i].append(tuple(row))
    assert got == want and sum(map(len, want)) > 20
    counted = K.gram_counts(hot.withColumn("w", F.col("v")), 3, "w").collect()
    assert [r.grams for r in sorted(counted, key=lambda r: r.id)] == list(map(len, want))
    assert not list(K.gram_matrices(np.zeros(0), np.zeros(1, np.int64), 3)) and not list(K.gram_matrices(np.zeros(8), np.array([0, 8, 8]), 3))


def test_repeated_grams_are_made_once():
    """What a text repeats costs its cosines once."""
    made = []
    filters = np.random.default_rng(2).normal(size=(3, 32))
    code, at = K.letters(pa.array(["ACGTTGCAN" * 400, "ACG", "ACGTTGCA"]), K.code_table("ATCG"))
    got = K.BaseFilters(filters, lambda z: made.append(len(z)) or np.cos(z)).features(code, at)
    assert sum(made) <= 20
    assert np.allclose(got, [plain(one_hot(t), filters, 4) for t in ("ACGTTGCAN" * 400, "ACG", "ACGTTGCA")])


def test_pairs_are_counted_in_batches(spark):
    texts = ["ACCA", None, "", "A", "éA", "CCé"]
    got = {r.pair: r.n for r in Q.pair_totals(spark.createDataFrame([(t,) for t in texts], "sequence string").coalesce(1)).collect()}
    assert got == {"AC": 1, "CC": 2, "CA": 1, "éA": 1, "Cé": 1}


def test_windows_of_zeros_are_not_multiplied():
    seen, rng = [], np.random.default_rng(2)
    flat, at, filters = np.zeros(600), np.array([0, 200, 203, 400, 600]), rng.normal(size=(3, 10))
    flat[[5, 450, 452]] = 1.0, 2.0, -2.0
    for phase in (None, rng.normal(size=3)):
        got = K.convolved(flat, at, lambda x: seen.append(len(x)) or x @ filters.T, 10, 3, 1, np.cos, phase)
        for i, (a, z) in enumerate(zip(at, at[1:])):
            w = np.lib.stride_tricks.sliding_window_view(flat[a:z], 10) if z - a >= 10 else np.zeros((0, 10))
            assert np.allclose(got[i], np.cos(w @ filters.T + (0 if phase is None else phase)).sum(0) * np.sqrt(2 / 3))
    assert seen == [18, 18]  # 6 of the first text, 12 of the last
