"""Queries over fitted models, random features and the composite jobs that use them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.labels import has_signal
from ..functions.sequence import dot
from ..operators import features as X, metrics as M, models as O, splits as P
from . import metric_queries as _metric_queries  # noqa: F401  its SQL is used below
from . import views as V
from .registry import ORACLES, query
from .views import sql

def _filters(count: int = 4, ngram: int = 3) -> np.ndarray:
    """Small fixed filters that SQL can spell: filter f, position p, base b is ((7 f + 5 p + 3 b) mod 11 - 5) / 10."""
    f, p, b = np.indices((count, ngram, 4))
    return (((7 * f + 5 * p + 3 * b) % 11 - 5) / 10.0).reshape(count, -1)


def _products(f: int) -> str:
    part = lambda p: f"CASE substr(seq, i + {p}, 1) " + " ".join(f"WHEN '{b}' THEN {((7 * f + 5 * p + 3 * k) % 11 - 5) / 10.0}" for k, b in enumerate("ATCG")) + " ELSE 0 END"
    return " + ".join(part(p) for p in range(3))


_GRAMS = ", g AS (SELECT id, seq, unnest(range(1, length(seq) - 1)) AS i FROM sequences)"
_KERNEL = f"{_GRAMS}, c AS (SELECT id, " + ", ".join(f"round(sum(cos(({_products(f)})::DOUBLE)) * sqrt(2.0 / 4), 5)::DOUBLE AS f{f}" for f in range(4)) + " FROM g GROUP BY id) SELECT s.id, " + ", ".join(f"CASE WHEN seq IS NOT NULL THEN coalesce(f{f}, 0.0::DOUBLE) END AS f{f}" for f in range(4)) + " FROM sequences s LEFT JOIN c USING (id)"


def _four(df):
    return df.select("id", *[F.round(F.get("features", F.lit(i)), 5).alias(f"f{i}") for i in range(4)])


@query("random_features", sql(_KERNEL, "sequences"))
def random_features(spark, d, view=V.sequences):
    """Features of one-hot vectors."""
    from ..operators.kernels import one_hot_column

    return _four(X.random_features(one_hot_column(view(spark, d), "ATCG", out="hot"), "hot", _filters()))


@query("featurize_sequence", sql(_KERNEL, "sequences"))
def featurize_sequence(spark, d, view=V.sequences):
    """The same features straight from the letters."""
    return _four(X.featurize_sequence(view(spark, d), _filters()))


def _stats(df):
    """Number of values and, rounded, the length of each window's feature vector."""
    return df.select("id", "window", F.size("features").alias("size"), F.round(F.sqrt(dot(F.col("features"), F.col("features"))), 3).alias("norm"))


def _windows(spark, d):
    """All windows of all documents with the cuts of their reads piled up by strand; without cuts, dnase is null."""
    from ..operators import coverage as C
    from ..operators.kernels import spread

    cut = C.cuts(V.document_reads(spark, d).select("contig", "start", "end", "strand")).filter("start >= 0")
    hits = cut.select(F.col("contig").cast("long").alias("id"), F.expr("start div 200").cast("int").alias("window"), "strand", (F.col("start") % 200).cast("int").alias("offset"), F.lit(1).alias("one"))
    return spread(V.sequence_windows(spark, d).join(C.sparse_pileup(hits, ["id", "window"], "one"), ["id", "window"], "left"), "cuts", 400, "dnase")


@query("random_features_fast")
def random_features_fast(spark, d):
    return _stats(X.featurize_sequence_phase(V.sequence_windows(spark, d), 64, 8))


@query("featurize_sequence_phase")
def featurize_sequence_phase(spark, d):
    return _stats(X.featurize_sequence_phase(V.sequence_windows(spark, d), 32, 6, seed=1))


@query("featurize_multiscale_signal")
def featurize_multiscale_signal(spark, d):
    return _stats(X.featurize_multiscale_signal(_windows(spark, d), _filters(8, 8)))


@query("featurize_signal")
def featurize_signal(spark, d):
    return _stats(X.featurize_signal(_windows(spark, d), _filters(8, 8), X.gaussian_filters(8, 50, seed=2)))


@query("featurize_concat_raw")
def featurize_concat_raw(spark, d):
    return _stats(X.featurize_concat_raw(_windows(spark, d), X.gaussian_filters(8, 32, seed=3)))


_W = "list_transform(range(0, 64), lambda i: ((i * 5) % 9 - 4) / 10.0::DOUBLE)"
_WEIGHTS = np.array([((i * 5) % 9 - 4) / 10.0 for i in range(64)])


@query("linear_predict", sql(f"SELECT id, round(list_inner_product(features, {_W}), 6) AS score FROM features", "features"))
def linear_predict(spark, d):
    return O.linear_predict(V.features(spark, d), _WEIGHTS).select("id", F.round("score", 6).alias("score"))


@query("gated_predict", sql(f"SELECT id, CASE WHEN features[1] > 0 THEN round(list_inner_product(features, {_W}), 6) ELSE 0.0::DOUBLE END AS score FROM features", "features"))
def gated_predict(spark, d):
    scored = O.linear_predict(V.features(spark, d), _WEIGHTS)
    return scored.select("id", O.gated(has_signal(F.slice("features", 1, 1)), F.round("score", 6)).alias("score"))


@query("ridge_fit", sql("SELECT round(1000 * sum(label * features[1]) / (sum(features[1] * features[1]) + 0.5), 4)::DOUBLE AS w FROM features", "features"))
def ridge_fit(spark, d):
    """The weight of the first feature alone, which SQL can state in closed form (in thousandths)."""
    one = V.features(spark, d).withColumn("features", F.slice("features", 1, 1))
    w = O.ridge_fit(one, 0.5)
    return one.agg(F.count("*").alias("n")).select(F.lit(round(1000 * float(w[0]), 4) if len(w) else 0.0).alias("w"))


@query("ridge_fit_whole")
def ridge_fit_whole(spark, d):
    """The weights of all features together, fitted block after block: place and w."""
    w = O.ridge_fit_blocks(V.features(spark, d), 0.5, block=16, epochs=200)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "place int, w double")


def _fit_and_score(spark, d, weights, predict):
    return predict(V.features(spark, d), weights).select("id", "label", F.round("score", 6).alias("score"))


@query("logistic_fit")
def logistic_fit(spark, d):
    f = V.features(spark, d)
    return _fit_and_score(spark, d, O.logistic_fit(f, 10, 0.01), O.logistic_predict)


@query("hard_negative_mining")
def hard_negative_mining(spark, d):
    weights, used = O.hard_negative_mining(V.features(spark, d).select("id", "label", "features"), 1.0, 0.2, 2, threshold=0.3)
    return used.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("cross_validate")
def cross_validate(spark, d):
    """Ridge models over folds of held-out cell types and contigs, for two rates of negatives and two regularisers."""
    f = V.features(spark, d)
    return O.cross_validate(P.with_holdouts(f, P.holdout_folds(f, 1, 2, folds=4)), 4, (0.5, 1.0), (0.1, 10.0))


# --- jobs ------------------------------------------------------------------------------


def _solved(spark, fit, data):
    """The model saved, loaded again, and scored on both parts."""
    from ..files import shared_path

    path = shared_path(spark, "model")
    fit.save(spark, path)
    return M.tagged_metrics(O.LinearModel.load(spark, path).predict(data.filter("split is not null")), "job", keys=["split"])


@query("job_solve")
def job_solve(spark, d):
    """Features to split to a ridge model with scaler and intercept, saved and loaded, to metrics of both parts."""
    data = P.train_val(V.features(spark, d), ["c1"], ["chr2", "chr3"])
    return _solved(spark, O.LinearModel.fit(P.sample_negatives(data.filter("split = 'train'"), 0.5, "id"), 1.0), data)


@query("job_solve_hard_negatives")
def job_solve_hard_negatives(spark, d):
    """The same on positives and mined negatives."""
    data = P.train_val(V.features(spark, d), ["c1"], ["chr2", "chr3"])
    _, used = O.hard_negative_mining(data.filter("split = 'train'").select("id", "label", "features"), 1.0, 0.3, 2)
    return _solved(spark, O.LinearModel.fit(used, 1.0), data)


@query("job_predict", sql(f", s AS (SELECT contig, id, list_inner_product(features, {_W}) AS score FROM features), b AS (SELECT min(score) AS lo, max(score) AS hi FROM s) SELECT contig, id * 50 AS start, round((score - lo) / (hi - lo), 5) AS score FROM s, b WHERE contig IN ('chr1', 'chr21', 'chr8')", "features"))
def job_predict(spark, d):
    """Features and a saved model with scaler and intercept to a board; the board is scaled, so that both leave it as it is."""
    from ..files import shared_path
    from ..operators.ranking import board_order

    path = shared_path(spark, "model")
    O.LinearModel(_WEIGHTS, 0.25, np.arange(64) / 640.0).save(spark, path)
    scored = O.LinearModel.load(spark, path).predict(V.features(spark, d))
    rows = scored.select("contig", (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 200).alias("end"), "score")
    return board_order(M.minmax_scale(rows, "score")).select("contig", "start", F.round("scaled", 5).alias("score"))


@query("job_cv_signal")
def job_cv_signal(spark, d):
    """Cuts to pile-ups to footprints to a gated logistic model, over folds of held-out cell types and contigs."""
    from ..operators import coverage as C

    hits = C.cut_windows(C.cuts(V.reads(spark, d))).withColumn("one", F.lit(1))
    table = C.with_footprint(C.pileup(hits, ["contig", "cell_type", "win_start"], "one"))
    busy = V.peaks(spark, d).filter("signal > 100").select("contig", "cell_type", (F.floor(F.col("start") / 50) * 50).alias("win_start")).distinct().withColumn("label", F.lit(1))
    data = table.join(busy, ["contig", "cell_type", "win_start"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    held = P.holdout_folds(V.reads(spark, d), 1, 1, folds=3)
    return O.cross_validate_logistic(P.with_holdouts(data, held), 3, 5, 0.1, gate=has_signal(F.col("dnase")))


def _documents(spark, d):
    """id, label and, as what may be held out, language and source of the labelled documents."""
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("cell_type"), F.col("source").alias("contig"))
    return V.scored(spark, d).select("id", "label").join(docs, "id")


def _cv(spark, d, features, folds=3):
    """Logistic models of quality over folds of held-out languages and sources; features has id and features."""
    docs = _documents(spark, d)
    return O.cross_validate_logistic(P.with_holdouts(features.join(docs, "id"), P.holdout_folds(docs, 1, 3, folds=folds)), folds, 5, 0.1)


@query("job_cv_signal_only")
def job_cv_signal_only(spark, d):
    """Whether a window has cuts at all."""
    from ..functions.labels import binary_signal

    return _cv(spark, d, _windows(spark, d).select("id", F.array(binary_signal(F.col("dnase"))).alias("features")))


@query("job_cv_kernel")
def job_cv_kernel(spark, d):
    return _cv(spark, d, X.featurize_sequence(V.sequence_windows(spark, d), X.gaussian_filters(32, 32)).select("id", "features"))


def _place(column, kinds):
    """Place of a value among the categories (from 0); null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, kinds)), column.cast("string")), F.lit(0)) - 1 if kinds else F.lit(None)


def _onehot_bits(texts, kinds, lang="lang"):
    """The one-hot vector of each window of the texts, and indicators of their language, as bits; zeros where a document's last window ends."""
    from ..operators.kernels import one_hot_bits

    return one_hot_bits(V.windowed(texts), "ATCG", 200, len(kinds), _place(F.col(lang), kinds))


def _onehot_features(spark, d):
    """The same as numbers, of all documents."""
    from ..functions.labels import fit_categories
    from ..operators.kernels import unpacked

    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    kinds = fit_categories(docs, "lang")
    return unpacked(_onehot_bits(V.whole_sequences(spark, d).join(docs, "id"), kinds), 800 + len(kinds)).select("id", "features")


@query("job_cv_onehot")
def job_cv_onehot(spark, d, folds=3):
    """A language that a fold holds out has an indicator that is zero in all its training rows, and so no weight."""
    from ..functions.labels import fit_categories

    docs = _documents(spark, d)
    texts = P.with_holdouts(V.whole_sequences(spark, d).join(docs, "id"), P.holdout_folds(docs, 1, 3, folds=folds))
    bits = _onehot_bits(texts.filter(_USED), fit_categories(V.table(spark, d, "documents"), "lang"), "cell_type")
    return O.cross_validate_logistic(bits, folds, 5, 0.1)


#: Rows that some fold trains or tests.
_USED = "size(train_folds) > 0 OR size(test_folds) > 0"


@query("job_cv_ngrams")
def job_cv_ngrams(spark, d, folds=2, top=1024):
    """The most frequent 6- and 7-grams and the language; vocabulary and categories are those of the fold's training documents."""
    from ..files import materialised
    from ..functions.labels import fit_categories
    from ..operators.kernels import packed
    from ..operators.sequences import grams, ngram_features, ngram_vocabulary

    docs = materialised(P.with_holdouts(_documents(spark, d).join(V.whole_sequences(spark, d), "id"), P.holdout_folds(_documents(spark, d), 1, 3, folds=folds)))
    out = None
    for fold in range(folds):
        train = docs.filter(F.array_contains("train_folds", fold))
        names, kinds = grams(ngram_vocabulary(train, top=top)), fit_categories(train, "cell_type")
        own = lambda c, fold=fold: F.filter(c, lambda x: x == fold)
        rows = docs.withColumns({"train_folds": own("train_folds"), "test_folds": own("test_folds")}).filter(_USED)
        rows = ngram_features(rows, names, keep=("label", "cell_type", "train_folds", "test_folds"))
        width, kind = max(1, len(names)), _place(F.col("cell_type"), kinds)
        places = F.concat("places", F.filter(F.array((kind + width).cast("int")), lambda x: x.isNotNull()))
        one = O.cross_validate_logistic(packed(rows.withColumn("places", places), "places", width + len(kinds)), folds, 5, 0.1).filter(F.col("fold") == fold)
        out = one if out is None else out.unionByName(one)
    return out


@query("job_cv_lift")
def job_cv_lift(spark, d):
    """What a random-feature model of k-mers has over their counts: both metrics of each hash fold, side by side.

    The counts are those of single letters of the whole document, as shares.
    """
    from ..operators.sequences import kmer_counts

    docs = V.scored(spark, d).select("id", "label")
    train, test = O.fold_sets(P.hash_fold(F.col("id"), 4), 4)
    seq = V.whole_sequences(spark, d)
    share = F.map_from_entries(F.collect_list(F.struct("kmer", (F.col("n") / F.col("all")).alias("v"))))
    single = kmer_counts(seq, 1).join(seq.select("id", F.length("sequence").alias("all")), "id").groupBy("id").agg(share.alias("m"))
    counts = single.select("id", F.array(*[F.coalesce(F.try_element_at("m", F.lit(b)), F.lit(0.0)) for b in "ACGT"]).alias("features"))
    kernel = X.featurize_sequence(seq, X.gaussian_filters(16, 16)).select("id", F.transform("features", lambda v: v / F.greatest(F.length("sequence"), F.lit(1))).alias("features"))
    both = [O.cross_validate_logistic(f.join(docs, "id").withColumns({"train_folds": train, "test_folds": test}), 4, 5, 1e-4, tag=tag) for f, tag in ((kernel, "kernel"), (counts, "counts"))]
    lift = F.round(F.col("kernel_auroc") - F.col("counts_auroc"), 9)
    return both[0].join(both[1].drop("train", "test", "test_positives"), "fold").withColumn("lift", lift)


@query("job_seq_benchmark")
def job_seq_benchmark(spark, d):
    """A sequence file to random features to a logistic model, scored on another file: documents of even and of odd id."""
    from ..sources.readers import scan_sequences

    docs = V.whole_sequences(spark, d).join(V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"), "id").filter("length(sequence) > 0")
    read = lambda name, part: scan_sequences(spark, _sequences_written(docs.filter(F.col("id") % 2 == part), name)).select("id", "label", "sequence")
    shares = lambda df: X.featurize_sequence(df, X.gaussian_filters(16, 32)).select("id", "label", F.transform("features", lambda v: v / F.length("sequence")).alias("features"))
    train, test = shares(read("EGR1_K562_AC.seq", 0)), shares(read("EGR1_K562_B.seq", 1))
    scored = O.logistic_predict(test, O.logistic_fit(train, 5, 0.1)).withColumn("score", F.round("score", 6))
    return M.tagged_metrics(scored, "test")


def _sequences_written(df, name):
    from .source_queries import _tsv

    rows = df.select(F.lit("A").alias("FoldID"), F.lpad(F.col("id").cast("string"), 15, "0").alias("EventID"), F.col("sequence").alias("seq"), F.col("quality").alias("Bound"))
    return _tsv(rows, name, header=True, sep="\t")


@query("job_features_signal")
def job_features_signal(spark, d):
    """Windows with sequence and signal to multiscale features."""
    return _stats(X.featurize_multiscale_signal(_windows(spark, d), _filters(4, 8)))


@query("job_features_seq")
def job_features_seq(spark, d):
    return _stats(X.featurize_sequence_phase(_windows(spark, d), 16, 8, seed=4))


_DATASET = """, c AS (SELECT g.contig, g.s, count(r.id) FILTER (r.cell_type = 'c0') AS c0, count(r.id) FILTER (r.cell_type = 'c1') AS c1, count(r.id) FILTER (r.cell_type = 'c2') AS c2
  FROM regions g LEFT JOIN dreads r ON r.contig = g.contig AND r.s < g.e AND g.s < r.e GROUP BY ALL),
p AS (SELECT g.contig, g.s, count(*) AS n FROM regions g JOIN dreads r ON r.contig = g.contig AND r.s < g.e AND g.s < r.pe AND r.s < r.pe GROUP BY ALL),
x AS (SELECT g.contig, g.s AS start, quality, toxic, coalesce(substr(f.seq, g.s + 1, 200), '') AS sequence, c0, c1, c2, coalesce(n, 0) AS peaks
  FROM regions g LEFT JOIN reference f USING (contig) JOIN c ON c.contig = g.contig AND c.s = g.s LEFT JOIN p ON p.contig = g.contig AND p.s = g.s)"""
_PARTS = ("document_regions", "document_reads", "reference")


def _dataset(spark, d):
    """Labelled regions with their sequence, their peaks and the reads over them by cell type."""
    from ..operators.intervals import overlap_join
    from ..operators.sequences import chunked, extract_sequences

    regions, reads = V.document_regions(spark, d), V.document_reads(spark, d)
    at = regions.select("contig", "start", "end")
    over = overlap_join(at, reads.select("contig", "start", "end", "cell_type")).groupBy("contig", "start").agg(*[F.count_if(F.col("r_cell_type") == c).alias(c) for c in ("c0", "c1", "c2")])
    peaks = overlap_join(at, reads.select("contig", "start", F.col("peak_end").alias("end"))).groupBy("contig", "start").agg(F.count("*").alias("peaks"))
    whole = extract_sequences(regions, chunked(V.reference(spark, d))).join(over, ["contig", "start"], "left").join(peaks, ["contig", "start"], "left")
    return whole.fillna(0, ["c0", "c1", "c2", "peaks"])


def _saved(spark, windows):
    """Written as windows by tf and read again."""
    from ..files import shared_path
    from ..sources.writers import write_windows

    path = shared_path(spark, "dataset")
    write_windows(windows, path)
    return spark.read.parquet(path)


@query("job_dataset_tf", sql(f"{_DATASET} SELECT contig, start, quality::INT AS label, sequence, peaks, c0, c1, c2 FROM x", *_PARTS))
def job_dataset_tf(spark, d):
    """One tf: labels to sequences, peaks and coverage of each cell type, saved and read again."""
    out = _dataset(spark, d).withColumn("tf", F.lit("EGR1")).withColumn("label", F.col("quality").cast("int"))
    return _saved(spark, out).select("contig", "start", "label", "sequence", "peaks", "c0", "c1", "c2")


@query("job_dataset_all_tf", sql(f"{_DATASET} SELECT 'EGR1' AS tf, contig, start, quality::INT AS label, sequence, peaks, c0, c1, c2 FROM x UNION ALL SELECT 'ATF2', contig, start, toxic::INT, sequence, peaks, c0, c1, c2 FROM x", *_PARTS))
def job_dataset_all_tf(spark, d):
    """Two tfs with labels of their own; sequences, peaks and coverage are loaded once for both."""
    labels = F.explode(F.array(F.struct(F.lit("EGR1").alias("tf"), F.col("quality").cast("int").alias("label")), F.struct(F.lit("ATF2").alias("tf"), F.col("toxic").cast("int").alias("label"))))
    out = _dataset(spark, d).withColumn("l", labels).select("*", "l.*").drop("l")
    return _saved(spark, out).select("tf", "contig", "start", "label", "sequence", "peaks", "c0", "c1", "c2")


@query("job_dataset_test", sql(f"{_DATASET} SELECT contig, start, -10 AS label, cell_type, sequence, CASE cell_type WHEN 'c0' THEN c0 ELSE c1 END AS reads FROM x, (SELECT unnest(['c0', 'c1']) AS cell_type)", *_PARTS))
def job_dataset_test(spark, d):
    """Unlabelled regions for each requested cell type, with their sequence and the reads of that type, saved and read again."""
    from ..functions.labels import UNLABELED

    asked = F.explode(F.array(*[F.struct(F.lit(c).alias("cell_type"), F.col(c).alias("reads")) for c in ("c0", "c1")]))
    out = _dataset(spark, d).withColumn("a", asked).select("contig", "start", "end", "sequence", "a.*", F.lit("EGR1").alias("tf"), F.lit(UNLABELED).alias("label"))
    return _saved(spark, out).select("contig", "start", "label", "cell_type", "sequence", "reads")


_TF_WHOLE = """, r AS (SELECT w.contig, w.s, count(m.id) AS reads, count(*) FILTER (m.cell_type = 'c0') AS c0, count(*) FILTER (m.cell_type = 'c1') AS c1, count(*) FILTER (m.cell_type = 'c2') AS c2
  FROM windows w LEFT JOIN reads m ON m.contig = w.contig AND m.s < w.e AND w.s < m.e AND m.s < m.e GROUP BY ALL),
p AS (SELECT w.contig, w.s, count(*) AS n FROM windows w JOIN peaks m ON m.contig = w.contig AND m.s < w.e AND w.s < m.e AND m.s < m.e GROUP BY ALL)
SELECT r.contig, r.s AS start, reads, c0, c1, c2, coalesce(n, 0) AS peaks FROM r LEFT JOIN p USING (contig, s)"""


@query("job_dataset_tf_whole", sql(_TF_WHOLE, "reads", "peaks", "windows"))
def job_dataset_tf_whole(spark, d):
    """All windows of the grid with their reads, the reads of each cell type and their peaks, saved and read again."""
    from ..files import materialised
    from ..operators.intervals import overlap_join

    w = V.windows(spark, d)
    reads = overlap_join(w, V.reads(spark, d).select("contig", "start", "end", "id", "cell_type"), how="left").groupBy("contig", "start")
    reads = reads.agg(F.count("r_id").alias("reads"), *[F.count_if(F.col("r_cell_type") == c).alias(c) for c in ("c0", "c1", "c2")])
    peaks = overlap_join(w, V.peaks(spark, d).select("contig", "start", "end")).groupBy("contig", "start").agg(F.count("*").alias("peaks"))
    return materialised(reads.join(peaks, ["contig", "start"], "left").withColumn("peaks", F.coalesce("peaks", F.lit(0).cast("long"))))


@query("job_dataset_all_tf_whole", sql(_TF_WHOLE.replace("SELECT r.contig,", "SELECT unnest(['EGR1', 'ATF2']) AS tf, r.contig,"), "reads", "peaks", "windows"))
def job_dataset_all_tf_whole(spark, d):
    return job_dataset_tf_whole(spark, d).select(F.explode(F.array(F.lit("EGR1"), F.lit("ATF2"))).alias("tf"), "*")


@query("job_dataset_test_whole", sql(" SELECT contig, s AS start, -10 AS label, c.cell_type FROM windows, (SELECT unnest(['c0', 'c1']) AS cell_type) c", "windows"))
def job_dataset_test_whole(spark, d):
    from ..functions.labels import UNLABELED

    return V.windows(spark, d).select("contig", "start", F.lit(UNLABELED).alias("label"), F.explode(F.array(F.lit("c0"), F.lit("c1"))).alias("cell_type"))


_SUBMITTED = """, sub AS (SELECT 'chr' || (doc_id % 3 + 1) AS contig, doc_id * 50 AS s, round(n_chars / (n_chars + 1000.0::DOUBLE), 6) AS score FROM documents WHERE lang = 'en'),
al AS (SELECT count(*) FILTER (sub.s IS NULL) AS only_truth, count(*) FILTER (w.s IS NULL) AS only_submission FROM wide w FULL JOIN sub ON sub.contig = w.contig AND sub.s = w.s),
rows AS (SELECT 1 AS k, q AS label, coalesce(score, 0.0)::DOUBLE AS score FROM wide w LEFT JOIN sub ON sub.contig = w.contig AND sub.s = w.s WHERE q >= 0)"""


@query("job_score", sql(f"{_SUBMITTED}{_metric_queries._CURVE} SELECT any_value(only_truth) AS only_truth, any_value(only_submission) AS only_submission, 0::BIGINT AS bad_scores, 0::BIGINT AS bad_labels, {_metric_queries._ROC} AS auroc, {_metric_queries._PRC} AS auprc, {_metric_queries._FDR(0.5)} AS recall_at_50_fdr, {_metric_queries._FDR(0.1)} AS recall_at_10_fdr FROM d, al", "wide"))
def job_score(spark, d):
    """A submission aligned with the labels, checked, filled with 0.0 where it has no score, and reported on without ambiguous regions."""
    from ..functions.labels import label_encode
    from ..operators import ranking as R

    truth = V.wide_labels(spark, d).select(F.col("chr").alias("contig"), "start", F.col("stop").alias("end"), F.col("HepG2").alias("label"))
    docs = V.table(spark, d, "documents").filter("lang = 'en'")
    start = F.col("doc_id") * 50
    submission = docs.select(F.concat(F.lit("chr"), (F.col("doc_id") % 3 + 1).cast("string")).alias("contig"), start.alias("start"), (start + 200).alias("end"), F.round(F.col("n_chars") / (F.col("n_chars") + 1000.0), 6).alias("score"))
    filled = R.template_join(truth.withColumn("label", label_encode(F.col("label"))), submission)
    report = M.classification_report(filled).select(*[F.round(c, 6).alias(c) for c in ("auroc", "auprc", "recall_at_50_fdr", "recall_at_10_fdr")])
    return R.aligned_check(truth, submission).crossJoin(F.broadcast(report))  # one row each


_Q = _metric_queries
_SUBMISSIONS = f""", rated AS (SELECT unnest([0, 1, 2, 3]) AS "user", unnest([score, round(1 - score, 6), (id * 37 % 1000) / 1000.0::DOUBLE, round(abs(score - 0.5), 6)]) AS score, id, label, toxic FROM scored),
rows AS (SELECT "user" * 100 + id % 3 AS k, label, score FROM rated UNION ALL SELECT "user" * 100 + 10 + id % 3, toxic, score FROM rated){_Q._CURVE},
u AS (SELECT k // 100 AS "user", CASE WHEN k // 10 % 10 = 0 THEN 'quality' ELSE 'toxic' END AS tf, 'all' AS sample, k % 10 AS bootstrap, {_Q._PRC} AS m0, {_Q._ROC} AS m1, {_Q._FDR(0.1)} AS m2, {_Q._FDR(0.5)} AS m3 FROM d GROUP BY k)"""


@query("job_rank", sql(_SUBMISSIONS + ORACLES["global_ranking"].split(_Q._BOARD)[1], "scored"))
def job_rank(spark, d):
    """Submissions of four users scored on every board and bootstrap, their metrics to combined ranks and the global ranking."""
    from ..operators.ranking import global_ranking

    s = V.scored(spark, d)
    score = F.col("score")
    users = [score, F.round(1 - score, 6), F.col("id") * 37 % 1000 / 1000.0, F.round(F.abs(score - 0.5), 6)]
    rated = s.select("id", "label", "toxic", F.explode(F.array(*[F.struct(F.lit(i).alias("user"), x.alias("score")) for i, x in enumerate(users)])).alias("r")).select("id", "label", "toxic", "r.*")
    boards = F.array(F.struct(F.lit("quality").alias("tf"), F.col("label").cast("int").alias("label")), F.struct(F.lit("toxic").alias("tf"), F.col("toxic").cast("int").alias("label")))
    rows = rated.select("user", "score", (F.col("id") % 3).alias("bootstrap"), F.explode(boards).alias("b")).select("user", "score", "bootstrap", "b.*")
    keys = ["user", "tf", "bootstrap"]
    values = [M.au_prc(), M.au_roc(), M.recall_at(0.1), M.recall_at(0.5)]
    metrics = M.curves(rows, keys).groupBy(*keys).agg(*[F.round(v, 6).alias(f"m{i}") for i, v in enumerate(values)]).withColumn("sample", F.lit("all"))
    out = global_ranking(metrics, ["m0", "m1", "m2", "m3"])
    return out.select("user", *[F.round(c, 6).alias(c) for c in ("min_score", "mean_score", "max_score")], "second_rank")
