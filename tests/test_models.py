"""Fitted models, folds, vocabularies and indexers against numpy and plain loops."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe import catalog
from locusframe.functions import labels as L
from locusframe.operators import features as X, metrics as M, models as O, sequences as Q, splits as P
from locusframe.plans import model_queries as J, views as V

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    """id, label (one is ambiguous), cell_type, contig and five features."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 5))
    y = (x @ [1.0, -1, 0.5, 0, 0] + rng.normal(size=240) > 0).astype(int)
    rows = [(i, -1 if i == 7 else int(v), f"t{i % 3}", f"chr{i % 5}", f.tolist()) for i, (v, f) in enumerate(zip(y, x, strict=True))]
    rows += [(240, 1, "t0", None, x[0].tolist()), (241, None, "t1", "chr1", x[1].tolist()), (242, 0, "t1", "chr1", None)]
    return spark.createDataFrame(rows, "id long, label int, cell_type string, contig string, features array<double>").repartition(3)


def test_holdouts_as_the_single_split(spark, table):
    held = P.holdout_folds(table.filter("contig IS NOT NULL"), 1, 2, folds=4)
    some = {f: {k: [r.value for r in held.collect() if (r.fold, r.kind) == (f, k)] for k in ("cell_type", "contig")} for f in range(4)}
    got = {r.id: (r.train_folds, r.test_folds) for r in P.with_holdouts(table, held).collect()}
    for f, v in some.items():
        split = {r.id: r.split for r in P.holdout(table.filter("contig IS NOT NULL"), v["cell_type"], v["contig"]).collect()}
        assert {i for i, s in split.items() if s == "train"} == {i for i, (a, _) in got.items() if f in a and i != 240}
        assert {i for i, s in split.items() if s == "test"} == {i for i, (_, b) in got.items() if f in b}


def folds_of(df, n):
    data = {r.id: r for r in df.filter("label IS NOT NULL AND features IS NOT NULL").collect()}
    return data, [([r for r in data.values() if f in r.train_folds], [r for r in data.values() if f in r.test_folds]) for f in range(n)]


def xy(rows):
    return np.array([r.features for r in rows]).reshape(len(rows), 5), np.array([r.label for r in rows], float)


def test_cross_validation_equals_numpy(spark, table):
    folded = P.with_holdouts(table, P.holdout_folds(table.filter("contig IS NOT NULL"), 1, 2, folds=3))
    rates, regs = (0.3, 1.0), (0.1, 10.0)
    models = O.fold_weights(folded, 3, rates, regs)
    got = {(r.fold, r.rate, r.reg): np.array(r.weights) for r in models.collect()}
    kept = {rate: {r.id for r in table.filter(P.keep_by_hash(F.col("id"), rate, 0)).collect()} for rate in rates}
    data, folds = folds_of(folded, 3)
    assert len(got) == 12
    for (fold, rate, reg), w in got.items():
        x, y = xy([r for r in folds[fold][0] if r.label == 1 or r.label == 0 and r.id in kept[rate]])
        assert np.allclose(w, np.linalg.solve(x.T @ x + reg * np.eye(5), x.T @ y))
    scores = sorted((r.fold, r.rate, r.reg, r.label, round(r.score, 9)) for r in O.fold_scores(folded, models).collect())
    want = sorted((f, rate, reg, float(r.label), round(float(np.dot(r.features, got[f, rate, reg])), 9)) for f, (_, test) in enumerate(folds) for r in test for rate in rates for reg in regs)
    assert np.allclose(np.array(scores), np.array(want))
    rows = O.cross_validate(folded, 3, rates, regs).collect()
    assert sorted((r.fold, r.rate, r.reg) for r in rows) == sorted(got)
    for r in rows:
        part = spark.createDataFrame([(s[3], s[4]) for s in want if s[:3] == (r.fold, r.rate, r.reg)], "label double, score double")
        assert r.test_auroc == pytest.approx(M.tagged_metrics(part, "t").first().t_auroc) and r.train == len(folds[r.fold][0])


def test_a_fold_without_test_rows_is_reported(spark, table):
    train, test = O.fold_sets(F.when(F.col("id") < 100, 0).otherwise(2), 3)
    rows = O.cross_validate(table.withColumns({"train_folds": train, "test_folds": test}), 3, (1.0,), (1.0,)).orderBy("fold").collect()
    assert [(r.fold, r.test > 0, r.test_ap is None) for r in rows] == [(0, True, False), (1, False, True), (2, True, False)]
    rows = O.cross_validate_logistic(table.withColumns({"train_folds": train, "test_folds": test}).filter("id < 100"), 3, 2, 0.1).orderBy("fold").collect()
    assert [(r.train, r.test > 0, r.cv_ap is None) for r in rows] == [(0, True, True), (100, False, True), (100, False, True)]


def test_logistic_folds_equal_newton_in_numpy(table):
    train, test = O.fold_sets(P.hash_fold(F.col("id"), 2), 2)
    folded = table.filter("label >= 0").withColumns({"train_folds": train, "test_folds": test})
    got = {r.fold: np.array(r.weights) for r in O.fold_logistic(folded, 2, 4, 0.05).collect()}
    _, folds = folds_of(folded, 2)
    for f, (rows, _) in enumerate(folds):
        x, y = xy(rows)
        x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(6)
        penalty = np.array([0.05 * len(x)] * 5 + [0.0])
        for _ in range(4):
            p = 1 / (1 + np.exp(-x @ w))
            w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * w)
        assert np.allclose(got[f], w)


def test_ridge_in_blocks_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(900, 300)), rng.normal(size=900)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "features array<double>, label double").repartition(2)
    w = O.ridge_fit_blocks(df, 300.0, block=64, tolerance=1e-8)
    assert np.allclose(w, np.linalg.solve(x.T @ x + 300 * np.eye(300), x.T @ y), atol=1e-7)
    assert len(O.ridge_fit_blocks(df.limit(0), 1.0)) == 0


def test_model_with_scaler_and_intercept(spark, table, tmp_path):
    rows = table.filter("label IS NOT NULL AND features IS NOT NULL")
    model = O.LinearModel.fit(table, 2.0)
    x, y = xy(rows.collect())
    c = x - x.mean(0)
    assert np.allclose(model.weights, np.linalg.solve(c.T @ c + 2 * np.eye(5), c.T @ (y - y.mean()))) and model.intercept == pytest.approx(y.mean())
    model.save(spark, f"file://{tmp_path}/m")
    again = O.LinearModel.load(spark, f"file://{tmp_path}/m")
    assert np.array_equal(again.weights, model.weights) and np.array_equal(again.means, model.means) and again.intercept == model.intercept
    got = {r.id: r.score for r in again.predict(table).collect()}
    assert got[242] is None and all(got[r.id] == pytest.approx((np.array(r.features) - x.mean(0)) @ model.weights + y.mean()) for r in rows.collect())
    assert O.LinearModel.fit(table.limit(0), 1.0).weights.size == 0


@pytest.mark.parametrize("capacity", [1 << 16, 4])
def test_vocabulary_is_exact_with_small_summaries(spark, capacity):
    rng = random.Random(3)
    texts = [None, "", " Ab "] + ["".join(rng.choice("abcdé" if i % 3 else "ab") for _ in range(rng.randint(0, 40))) for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, sequence string").repartition(4)
    grams = [{s[i : i + k] for k in (2, 3) for s in [(t or "").strip(" ").lower()] for i in range(len(s) - k + 1)} for t in texts]
    count = Counter(g for some in grams for g in some)
    want = sorted(count.items(), key=lambda x: (-x[1], x[0].encode()))[:12]
    got = Q.ngram_vocabulary(df, (2, 3), 12, capacity=capacity).orderBy("place").collect()
    assert [(r.gram, r.n, r.place) for r in got] == [(g, n, i) for i, (g, n) in enumerate(want)]
    names = [g for g, _ in want]
    assert {r.id: r.places for r in Q.ngram_features(df, names).collect()} == {i: [p for p, g in enumerate(names) if g in some] for i, some in enumerate(grams)}
    assert Q.ngram_features(df, []).filter("size(places) > 0").count() == 0


def test_bits_give_the_models_of_their_numbers(spark):
    from locusframe.operators.kernels import one_hot_bits, packed, unpacked

    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ATCGN") for _ in range(rng.randint(0, 5))), rng.choice([0, 2, None]), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, sequence string, kind int, label int")
    bits = one_hot_bits(df, "ATCG", 5, 3, F.col("kind"))
    numbers = unpacked(bits, 23)
    want = {i: [float(t[j : j + 1] == b) for j in range(5) for b in "ATCG"] + [float(kind == k) for k in range(3)] for i, t, kind, _ in rows}
    assert {r.id: r.features for r in numbers.collect()} == want
    places = numbers.withColumn("at", F.expr("filter(sequence(0, 22), i -> features[i] > 0)")).drop("features")
    assert {r.id: bytes(r.features) for r in packed(places, "at", 23).collect()} == {r.id: bytes(r.features) for r in bits.collect()}
    train, test = O.fold_sets(P.hash_fold(F.col("id"), 2), 2)
    models = [{r.fold: np.array(r.weights) for r in O.fold_logistic(x.withColumns({"train_folds": train, "test_folds": test}), 2, 4, 0.1).collect()} for x in (bits, numbers)]
    for f in range(2):  # bits are padded to 24 numbers, before the intercept
        assert np.allclose(np.delete(models[0][f], 23), models[1][f]) and models[0][f][23] == pytest.approx(0)


def test_vocabulary_without_drops_reads_the_texts_once(spark, monkeypatch):
    """Small alphabets are numbered, others hashed; if no summary dropped an n-gram, its counts are the result."""
    monkeypatch.setattr(Q, "_exact", lambda *_: pytest.fail("a second scan"))
    rng = random.Random(4)
    texts = [None, "", "n"] + ["".join(rng.choice("acgtn" if i % 2 else "acgtné€😀") for _ in range(rng.randint(0, 60))) for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, sequence string").repartition(3)
    grams = [{t[i : i + k] for k in (6, 7) for i in range(len(t or "") - k + 1)} if t else set() for t in texts]
    want = sorted(Counter(g for some in grams for g in some).items(), key=lambda x: (-x[1], x[0].encode()))[:40]
    for kinds in (1 << 20, 1):
        monkeypatch.setattr(Q, "KINDS", kinds)
        assert [(r.gram, r.n) for r in Q.ngram_vocabulary(df, top=40).orderBy("place").collect()] == want
        names = [g for g, _ in want]
        found = {r.id: r.places for r in Q.ngram_features(df, names, keep=("sequence",)).collect()}
        assert found == {i: [p for p, g in enumerate(names) if g in some] for i, some in enumerate(grams)}


def test_categories_of_one_table_on_another(spark, monkeypatch):
    fitted = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",), ("a",)], "v string")
    names = L.fit_categories(fitted, "v")
    assert names == ["a", "b", "c"]
    other = spark.createDataFrame([("c",), ("new",), (None,), ("a",)], "v string").select(L.category_features(F.col("v"), names).alias("x"))
    assert [r.x for r in other.collect()] == [[0, 0, 1], [0, 0, 0], [0, 0, 0], [1, 0, 0]]
    monkeypatch.setattr(L, "CATEGORIES", 2)
    with pytest.raises(ValueError):
        L.fit_categories(fitted, "v")


# --- queries without SQL ---------------------------------------------------------------


def windows(spark):
    rows = J._windows(spark, DATA).select("id", "window", "sequence", "dnase").collect()
    return {(r.id, r.window): (r.sequence, np.array(r.dnase) if r.dnase else np.zeros(400)) for r in rows}


def one_hot(text):
    return np.array([[c == b for b in "ATCG"] for c in text], float).ravel()


def plain(x, filters, alphabet, phase=0.0):
    if len(x) < filters.shape[1]:
        return np.zeros(len(filters))
    return np.cos(np.lib.stride_tricks.sliding_window_view(x, filters.shape[1])[::alphabet] @ filters.T + phase).sum(0) * np.sqrt(2 / len(filters))


def fast(count, ngram, seed):
    filters, phase = X.FastFilters(ngram * 4, count, 1.0, seed).matrix(ngram * 4), np.random.default_rng(seed + 1).uniform(0, 2 * np.pi, count)
    return lambda t, s: plain(one_hot(t), filters, 4, phase)


def multiscale(filters):
    banks = [X.gaussian_filters(len(filters), w, seed=i) for i, w in enumerate((100, 50, 25, 12, 6))]
    return lambda t, s: np.concatenate([plain(one_hot(t), filters, 4), *(np.prod([plain(x, b, 1) for b in banks], axis=0) for x in (s[:200], s[200:]))])


QUERIES = {
    "random_features_fast": fast(64, 8, 0),
    "featurize_sequence_phase": fast(32, 6, 1),
    "job_features_seq": fast(16, 8, 4),
    "featurize_multiscale_signal": multiscale(J._filters(8, 8)),
    "job_features_signal": multiscale(J._filters(4, 8)),
    "featurize_signal": lambda t, s: np.concatenate([plain(one_hot(t), J._filters(8, 8), 4), *(plain(x, X.gaussian_filters(8, 50, seed=2), 1) for x in (s[:200], s[200:]))]),
    "featurize_concat_raw": lambda t, s: plain(np.concatenate([one_hot(t), s]), X.gaussian_filters(8, 32, seed=3), 1),
}


@pytest.mark.parametrize("name", QUERIES)
def test_feature_queries_equal_plain_products(spark, name):
    want = {k: QUERIES[name](*v) for k, v in windows(spark).items()}
    got = {(r.id, r.window): (r.size, r.norm) for r in catalog.QUERIES[name](spark, DATA).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == len(x) and got[k][1] == pytest.approx(np.linalg.norm(x), abs=2e-3) for k, x in want.items())


def test_signals_are_the_cuts_of_the_reads(spark):
    cuts = Counter()
    for r in V.document_reads(spark, DATA).collect():
        for at in (r.start, r.end):
            at -= r.strand == "-"
            if at >= 0 and r.start >= 0:
                cuts[int(r.contig), at // 200, at % 200 + 200 * (r.strand == "-")] += 1
    got = {(i, w, p): n for (i, w), (_, s) in windows(spark).items() for p, n in enumerate(s) if n}
    assert got and all(cuts[k] == n for k, n in got.items())
    there = {k[:2] for k in windows(spark)}
    assert sum(got.values()) == sum(n for k, n in cuts.items() if k[:2] in there)


def test_lift_compares_both_models_on_the_same_rows(spark):
    rows = catalog.QUERIES["job_cv_lift"](spark, DATA).collect()
    assert [r.fold for r in sorted(rows, key=lambda r: r.fold)] == [0, 1, 2, 3] and sum(r.test for r in rows) == V.scored(spark, DATA).count()
    assert all(r.lift == pytest.approx(r.kernel_auroc - r.counts_auroc) for r in rows)


def test_ngram_job_sees_training_documents_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "ngram_vocabulary", lambda df, top, real=Q.ngram_vocabulary: seen.append({r.id for r in df.select("id").collect()}) or real(df, top=top))
    rows = J.job_cv_ngrams(spark, DATA, folds=2, top=50).collect()
    docs = P.with_holdouts(J._documents(spark, DATA), P.holdout_folds(J._documents(spark, DATA), 1, 3, folds=2)).collect()
    assert seen == [{r.id for r in docs if f in r.train_folds} for f in range(2)] and sorted(r.fold for r in rows) == [0, 1]


def test_benchmark_trains_and_tests_on_different_documents(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(J, "_sequences_written", lambda df, name, real=J._sequences_written: seen.setdefault(name, {r.id for r in df.select("id").collect()}) and real(df, name))
    assert catalog.QUERIES["job_seq_benchmark"](spark, DATA).count() == 1
    assert len(seen) == 2 and not set.intersection(*seen.values())

