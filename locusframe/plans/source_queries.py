"""Queries that write the views as files of the domain's formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..files import shared_path
from ..operators import coverage as C, intervals as I, models as O
from ..sources import readers as R, writers as W
from . import views as V
from .registry import ORACLES, query
from .views import sql


def _tsv(df, name: str, header: bool = False, sep: str = "\t") -> str:
    path = shared_path(df.sparkSession, name)
    df.write.option("sep", sep).option("header", header).csv(path)
    return path


def _label_file(spark, d, name="ARID3A.train.labels.tsv"):
    return _tsv(V.wide_labels(spark, d), name, header=True)


_LONG = "SELECT '{0}' AS tf, 'HepG2' AS cell_type, contig, s AS start, q AS label FROM wide UNION ALL SELECT '{0}', 'MCF-7', contig, s, t FROM wide"


@query("scan_tsv", "SELECT n_name AS name, n_regionkey::VARCHAR AS region FROM nation WHERE NOT contains(n_name || chr(9) || n_regionkey, '1')")
def scan_tsv(spark, d):
    path = _tsv(V.table(spark, d, "nation").select("n_name", "n_regionkey"), "nation.tsv")
    return R.scan_delimited(spark, path, "1").select(F.get("fields", F.lit(0)).alias("name"), F.get("fields", F.lit(1)).alias("region"))


@query("scan_csv", "SELECT c_name AS name, c_nationkey::VARCHAR AS nation FROM customer WHERE NOT contains(c_name || ',' || c_nationkey, '7')")
def scan_csv(spark, d):
    path = _tsv(V.table(spark, d, "customer").select("c_name", "c_nationkey"), "customer.csv", sep=",")
    return R.scan_delimited(spark, path, "7", ",").select(F.get("fields", F.lit(0)).alias("name"), F.get("fields", F.lit(1)).alias("nation"))


@query("scan_labels", sql(_LONG.format("ARID3A"), "wide"))
def scan_labels(spark, d):
    return R.scan_labels(spark, _label_file(spark, d)).select("tf", "cell_type", "contig", "start", "label")


@query("scan_label_folder", sql(f"{_LONG.format('ARID3A')} UNION ALL {_LONG.format('EGR1')}", "wide"))
def scan_label_folder(spark, d):
    return R.scan_label_folder(spark, [_label_file(spark, d), _label_file(spark, d, "EGR1.train.labels.tsv")]).select("tf", "cell_type", "contig", "start", "label")


@query("scan_labels_max", sql("SELECT contig, s AS start, greatest(q, t) AS label FROM wide", "wide"))
def scan_labels_max(spark, d):
    return R.scan_labels_max(spark, _label_file(spark, d)).select("contig", "start", "label")


def _peak_file(spark, d, cell: str, where: str = "true") -> str:
    p = V.peaks(spark, d).filter(where)
    rows = p.select("contig", "start", "end", F.lit(".").alias("name"), (F.col("id") % 1000).cast("int").alias("score"), F.lit(".").alias("strand"), "signal", F.lit(-1.0).alias("p"), F.lit(-1.0).alias("q"), F.lit(-1).alias("peak"))
    return _tsv(rows, f"DNASE.{cell}.narrowPeak")


@query("scan_peaks", sql("SELECT contig, s AS start, e AS \"end\", 'A549' AS cell_type, (id % 1000)::INT AS score, round(signal, 6) AS signal FROM peaks", "peaks"))
def scan_peaks(spark, d):
    return R.scan_peaks(spark, _peak_file(spark, d, "A549")).select("contig", "start", "end", "cell_type", "score", F.round("signalValue", 6).alias("signal"))


@query("scan_peak_files", sql("SELECT CASE cell_type WHEN 'c0' THEN 'A549' ELSE 'K562' END AS cell_type, count(*) AS n, round(sum(signal), 4) AS signal FROM peaks WHERE cell_type IN ('c0', 'c1') GROUP BY 1", "peaks"))
def scan_peak_files(spark, d):
    paths = [_peak_file(spark, d, "A549", "cell_type = 'c0'"), _peak_file(spark, d, "K562", "cell_type = 'c1'")]
    return R.scan_peaks(spark, paths).groupBy("cell_type").agg(F.count("*").alias("n"), F.round(F.sum("signalValue"), 4).alias("signal"))


@query("scan_peak_folder", sql("SELECT CASE cell_type WHEN 'c0' THEN 'A549' WHEN 'c1' THEN 'K562' ELSE 'GM12878' END AS cell_type, count(*) AS n FROM peaks GROUP BY 1", "peaks"))
def scan_peak_folder(spark, d):
    paths = [_peak_file(spark, d, name, f"cell_type = 'c{i}'") for i, name in enumerate(("A549", "K562", "GM12878"))]
    return R.scan_peaks(spark, paths).groupBy("cell_type").agg(F.count("*").alias("n"))


@query("scan_wig", sql("SELECT contig, s AS start, -1 AS score, round(signal, 6) AS signal FROM peaks", "peaks"))
def scan_wig(spark, d):
    p = V.peaks(spark, d)
    path = shared_path(spark, "signal.wig")
    lines = p.select(F.concat_ws("\t", "contig", "start", "end", "signal").alias("value"))
    lines.union(p.limit(1).select(F.lit("#track type=wig"))).write.text(path)
    return R.scan_wig(spark, path).select("contig", "start", "score", F.round("signalValue", 6).alias("signal"))


def _motif_file(spark, d, tf, where="true"):
    p = V.peaks(spark, d).filter(where)
    return _tsv(p.select(F.lit("m"), "contig", "start", "end", F.lit("+"), (F.col("id") % 50).cast("double"), F.lit(0.25)), f"{tf}_hits.tsv")


@query("scan_motif_hits", sql("SELECT 'EGR1' AS tf, contig, s AS start, (id % 50)::DOUBLE AS peak, 0.25::DOUBLE AS p FROM peaks", "peaks"))
def scan_motif_hits(spark, d):
    return R.scan_motif_hits(spark, _motif_file(spark, d, "EGR1")).select("tf", "contig", "start", "peak", F.col("pValue").alias("p"))


@query("scan_motif_folder", sql("SELECT CASE cell_type WHEN 'c0' THEN 'EGR1' ELSE 'ATF2' END AS tf, count(*) AS n FROM peaks WHERE cell_type <> 'c2' GROUP BY 1", "peaks"))
def scan_motif_folder(spark, d):
    paths = [_motif_file(spark, d, tf, f"cell_type = 'c{i}'") for i, tf in enumerate(("EGR1", "ATF2", "ARID3A"))]
    return R.scan_motif_hits(spark, paths, ["EGR1", "ATF2"]).groupBy("tf").agg(F.count("*").alias("n"))


def _gtf(spark, d):
    g = V.genes(spark, d)
    row = lambda kind: g.select("contig", F.lit("src"), F.lit(kind).alias("f"), "start", "end", F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "t"; level 2;')))
    path = shared_path(spark, "genes.gtf")
    both = row("gene").union(row("exon")).toDF(*"abcdefghi")
    both.select(F.concat_ws("\t", *"abcdefghi").alias("value")).union(spark.range(1).select(F.lit("##format: gtf"))).write.text(path)
    return path


@query("scan_gtf_genes", sql("SELECT gene_id, transcript_id, contig, s AS start, e AS \"end\" FROM genes", "genes"))
def scan_gtf_genes(spark, d):
    return R.scan_genes(spark, _gtf(spark, d)).select("gene_id", "transcript_id", "contig", "start", "end")


def _expression_file(spark, d, cell="A549", where="true"):
    return _tsv(V.expression(spark, d).filter(where), f"expression.{cell}.tsv", header=True)


@query("scan_expression", sql("SELECT contig, count(*) AS n, round(sum(expected_count), 2) AS counts FROM expression JOIN genes USING (gene_id) GROUP BY contig", "expression", "genes"))
def scan_expression(spark, d):
    rows = R.scan_expression(spark, _expression_file(spark, d), R.scan_genes(spark, _gtf(spark, d)))
    return rows.groupBy("contig").agg(F.count("*").alias("n"), F.round(F.sum("expected_count"), 2).alias("counts"))


@query("scan_expression_folder", sql("SELECT CASE WHEN length < 25 THEN 'A549' ELSE 'K562' END AS cell_type, count(*) AS n FROM expression JOIN genes USING (gene_id) GROUP BY 1", "expression", "genes"))
def scan_expression_folder(spark, d):
    paths = [_expression_file(spark, d, "A549", "length < 25"), _expression_file(spark, d, "K562", "length >= 25")]
    return R.scan_expression(spark, paths, V.genes(spark, d)).groupBy("cell_type").agg(F.count("*").alias("n"))


@query("join_expression", sql("SELECT gene_id, contig, s AS start, round(sum(FPKM), 4) AS fpkm FROM expression JOIN genes USING (gene_id) GROUP BY ALL", "expression", "genes"))
def join_expression(spark, d):
    out = R.join_expression(V.expression(spark, d), V.genes(spark, d))
    return out.groupBy("gene_id", "contig", "start").agg(F.round(F.sum("FPKM"), 4).alias("fpkm"))


def _coverage_file(spark, d):
    path = shared_path(spark, "coverage")
    W.write_coverage(C.strand_coverage(C.cuts(V.reads(spark, d)), ["cell_type"]), path)
    return path


_COV = ", cov AS (SELECT cell_type, contig, s, strand, count(*) / f.n::DOUBLE AS v FROM cuts JOIN (SELECT cell_type, count(DISTINCT file) AS n FROM cuts GROUP BY cell_type) f USING (cell_type) GROUP BY cell_type, contig, s, strand, f.n)"


@query("scan_coverage_cell", sql(f"{_COV} SELECT contig, strand, count(*) AS n, round(sum(v), 4) AS total FROM cov WHERE cell_type = 'c1' GROUP BY ALL", "reads", "cuts"))
def scan_coverage_cell(spark, d):
    return R.scan_coverage(spark, _coverage_file(spark, d), "c1").groupBy("contig", "strand").agg(F.count("*").alias("n"), F.round(F.sum("count"), 4).alias("total"))


@query("scan_coverage_all", sql(f"{_COV} SELECT cell_type, strand, count(*) AS n, round(sum(v), 4) AS total FROM cov GROUP BY ALL", "reads", "cuts"))
def scan_coverage_all(spark, d):
    return R.scan_coverage(spark, _coverage_file(spark, d)).groupBy("cell_type", "strand").agg(F.count("*").alias("n"), F.round(F.sum("count"), 4).alias("total"))


@query("write_coverage", sql(f"{_COV} SELECT count(*) AS n, round(sum(v), 4) AS total FROM cov", "reads", "cuts"))
def write_coverage(spark, d):
    return spark.read.parquet(_coverage_file(spark, d)).agg(F.count("*").alias("n"), F.round(F.sum("count"), 4).alias("total"))


@query("scan_reads", sql("SELECT id, contig, s AS start, strand FROM reads WHERE s >= 0", "reads"))
def scan_reads(spark, d):
    path = shared_path(spark, "reads")
    V.reads(spark, d).write.parquet(path)
    return R.scan_reads(spark, path).select("id", "contig", "start", "strand")


@query("scan_regions", sql("SELECT id::VARCHAR AS contig, 0 AS start, seq AS sequence FROM sequences WHERE length(seq) > 0", "sequences"))
def scan_regions(spark, d, view=V.sequences):
    rows = view(spark, d).filter("length(sequence) > 0").select(F.col("id").cast("string"), F.lit(0), F.length("sequence"), "sequence")
    return R.scan_regions(spark, _tsv(rows, "regions.bed")).select("contig", "start", "sequence")


def _windows(spark, d, view=V.sequences):
    """Labelled windows of the sequences with a signal of three numbers, a peak and an expression record."""
    s = view(spark, d).withColumn("start", F.col("id") * 50)
    peak = F.struct(F.lit("chr1").alias("contig"), F.col("start"), (F.col("start") + 9).alias("end"), F.lit(5).alias("score"), F.lit(1.5).alias("signalValue"), F.lit(-1.0).alias("pValue"), F.lit(-1.0).alias("qValue"), F.lit(-1.0).alias("peak"))
    return s.select(
        (F.col("id") % 2).cast("int").alias("label"), F.lit("EGR1").alias("tf"), F.lit("K562").alias("cell_type"), F.lit("chr1").alias("contig"), "start", (F.col("start") + 200).alias("end"), "sequence",
        (F.col("id") % 4).cast("int").alias("dnase_peak_count"), F.when(F.col("id") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.5), (F.col("id") % 7).cast("double"), F.lit(2.0))).alias("dnase"),
        F.when(F.col("id") % 2 == 0, F.array(peak, peak)).otherwise(F.array(peak)).alias("motifs"),
    )


_WIN = "SELECT (id % 2)::INT AS label, id * 50 AS start, seq AS sequence, (id % 4)::INT AS peaks, CASE WHEN id % 3 = 0 THEN 0 ELSE 2.5::DOUBLE + id % 7 END::DOUBLE AS signal, (2 - id % 2)::INT AS motifs FROM sequences"


def _shown(df):
    signal = F.aggregate("dnase", F.lit(0.0), lambda a, v: a + v)
    return df.select("label", "start", F.coalesce("sequence", F.lit("")).alias("sequence"), F.col("dnase_peak_count").alias("peaks"), signal.alias("signal"), F.size("motifs").alias("motifs"))


@query("scan_windows", sql(_WIN, "sequences"))
def scan_windows(spark, d, view=V.sequences):
    path = shared_path(spark, "windows")
    W.write_windows(_windows(spark, d, view), path, text=True)
    return _shown(R.scan_windows(spark, path))


@query("write_windows", sql(_WIN, "sequences"))
def write_windows(spark, d, view=V.sequences):
    path = shared_path(spark, "windows")
    W.write_windows(_windows(spark, d, view), path)
    return _shown(spark.read.parquet(path))


@query("scan_featurized", sql("SELECT id * 50 AS start, (id % 9) + 0.25::DOUBLE AS feature, 2 AS size FROM sequences", "sequences"))
def scan_featurized(spark, d):
    """Windows and features read from their lines."""
    return R.scan_featurized(spark, _featurized_text(spark, d)).select("start", F.get("features", F.lit(0)).alias("feature"), F.size("features").alias("size"))


@query("write_featurized", sql("SELECT id * 50 AS start, ((id % 9) + 0.25::DOUBLE)::VARCHAR || ',1.0' AS features FROM sequences", "sequences"))
def write_featurized(spark, d):
    """The lines as they lie there: the window's start, and its features behind the mark."""
    lines = spark.read.text(_featurized_text(spark, d))
    return lines.select(F.split_part("value", F.lit(","), F.lit(5)).cast("long").alias("start"), F.substring_index("value", "#", -1).alias("features"))


def _featurized_text(spark, d):
    path = shared_path(spark, "featurized")
    rows = _windows(spark, d).withColumn("features", F.array(F.col("start") / 50 % 9 + 0.25, F.lit(1.0)))
    W.write_featurized(rows, path)
    return path


@query("record_csv", sql("SELECT id, contig, s AS start, e AS \"end\", round(signal, 6) AS signal FROM peaks", "peaks"))
def record_csv(spark, d):
    """Peak records as text and back."""
    fields = [F.col("contig"), F.col("start"), F.col("end"), F.lit(1), F.col("signal"), F.lit(-1.0), F.lit(-1.0), F.lit(-1.0)]
    text = V.peaks(spark, d).select("id", W.record_csv(fields).alias("t")).select("id", W.record_fields(F.col("t"), R.PEAK_FORM).alias("r"))
    return text.select("id", "r.contig", "r.start", "r.end", F.round("r.signalValue", 6).alias("signal"))


def _sequence_file(spark, d, name, sep="\t", view=V.sequences):
    rows = view(spark, d).select(F.lit("A").alias("FoldID"), F.lpad(F.col("id").cast("string"), 15, "0").alias("EventID"), F.col("sequence").alias("seq"), (F.col("id") % 2).alias("Bound"))
    return _tsv(rows.filter("length(seq) > 0"), name, header=True, sep=sep)


_SEQ = "SELECT 'EGR1' AS tf, 'K562' AS cell_type, lpad(id::VARCHAR, 15, '0') AS id, seq AS sequence, (id % 2)::INT AS label FROM sequences WHERE length(seq) > 0"


@query("scan_seq_train", sql(_SEQ, "sequences"))
def scan_seq_train(spark, d, view=V.sequences):
    return R.scan_sequences(spark, _sequence_file(spark, d, "EGR1_K562_AC.seq", view=view))


@query("scan_seq_test", sql(f"{_SEQ} ORDER BY lpad(id::VARCHAR, 15, '0') LIMIT 200", "sequences"))
def scan_seq_test(spark, d, view=V.sequences):
    return R.scan_sequences(spark, _sequence_file(spark, d, "EGR1_K562_B.seq", view=view), first=200)


@query("scan_seq_concord", sql(f"{_SEQ} UNION ALL {_SEQ}", "sequences"))
def scan_seq_concord(spark, d, view=V.sequences):
    train = R.scan_sequences(spark, _sequence_file(spark, d, "EGR1_K562_AC.seq", " ", view=view), " ")
    return train.unionByName(R.scan_sequences(spark, _sequence_file(spark, d, "EGR1_K562_B.seq", view=view)))


@query("job_seq_counts", sql("SELECT 'AC' AS part, count(*) AS n FROM sequences WHERE length(seq) > 0 UNION ALL SELECT 'B', count(*) FROM sequences WHERE length(seq) > 0", "sequences"))
def job_seq_counts(spark, d):
    count = lambda part: R.scan_sequences(spark, _sequence_file(spark, d, f"EGR1_K562_{part}.seq")).agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return count("AC").unionByName(count("B"))


def _scored_regions(spark, d):
    return V.scored(spark, d).select("id", F.concat(F.lit("chr"), (F.col("id") % 8 + 1).cast("string")).alias("contig"), (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 200).alias("end"), "label", "score")


@query("write_scores", sql("SELECT 'chr' || (id % 8 + 1) AS contig, id * 50 AS start, score FROM scored", "scored"))
def write_scores(spark, d):
    path = shared_path(spark, "scores")
    W.write_scores(_scored_regions(spark, d), path)
    return spark.read.option("sep", "\t").schema("contig string, start long, end long, score double").csv(path).select("contig", "start", "score")


@query("write_predictions", sql("SELECT label::INT AS label, score FROM scored", "scored"))
def write_predictions(spark, d):
    path = shared_path(spark, "predictions")
    W.write_predictions(_scored_regions(spark, d), path)
    return spark.read.schema("label int, score double").csv(path)


@query("write_prediction_features", sql("SELECT id * 50 AS start, label AS phase, score FROM scored", "scored"))
def write_prediction_features(spark, d):
    path = shared_path(spark, "prediction_features")
    W.write_prediction_features(_scored_regions(spark, d), path)
    return spark.read.parquet(path).select("start", "phase", "score")


_BOARD = "SELECT 'chr' || (id % 8 + 1) AS contig, id * 50 AS start, round((score - lo) / (hi - lo), 6) AS score FROM scored, (SELECT min(score) AS lo, max(score) AS hi FROM scored) WHERE id % 8 + 1 IN (1, 8)"


@query("write_board", sql(_BOARD, "scored"))
def write_board(spark, d):
    path = shared_path(spark, "board")
    W.write_board(_scored_regions(spark, d), path, ("chr1", "chr21", "chr8"))
    return spark.read.option("sep", "\t").schema("contig string, start long, end long, score double").csv(path).select("contig", "start", "score")


@query("write_cuts", sql("SELECT cell_type, count(*) AS n FROM cuts GROUP BY cell_type", "reads", "cuts"))
def write_cuts(spark, d):
    """The second write finds the output there and leaves it."""
    path = shared_path(spark, "cuts")
    cut = C.cuts(V.reads(spark, d))
    W.write_cuts(cut, path)
    W.write_cuts(cut.limit(1), path)
    return spark.read.parquet(path).groupBy("cell_type").agg(F.count("*").alias("n"))


_MEANS = ", means AS (SELECT row, avg(v) AS w FROM (SELECT unnest(range(0, len(features)))::INT AS row, unnest(features) AS v FROM features) GROUP BY row)"


def _means(spark, d):
    """The mean feature vector, summed in the tasks, as a saved model."""
    import numpy as np

    mean = V.features(spark, d).select(F.posexplode("features").alias("row", "v")).groupBy("row").agg(F.avg("v").alias("w"))
    w = mean.orderBy("row").toPandas()["w"].to_numpy(np.float64)  # one number a feature
    path = shared_path(spark, "model")
    O.save_model(spark, w, path)
    return path


@query("save_model", sql(f"{_MEANS} SELECT row, round(w, 6) AS w FROM means", "features"))
def save_model(spark, d):
    """The mean of all vectors as weights, saved; its rows as they lie there."""
    return spark.read.parquet(_means(spark, d)).select("row", F.round("w", 6).alias("w"))


@query("load_model", sql(f"{_MEANS}, m AS (SELECT list(w ORDER BY row) AS w FROM means) SELECT id, round(list_inner_product(features, w) - list_inner_product(w, w) + 0.25, 5) AS score FROM features, m", "features"))
def load_model(spark, d):
    """Scores of all vectors under a model with scaler and intercept that was saved and loaded: the mean vector weighs what is above the mean."""
    w, path = O.load_model(spark, _means(spark, d)).reshape(-1), shared_path(spark, "scaled")
    O.LinearModel(w, 0.25, w).save(spark, path)
    return O.LinearModel.load(spark, path).predict(V.features(spark, d)).select("id", F.round("score", 5).alias("score"))


@query(
    "job_dataset",
    sql(
        """, m AS (SELECT contig, s, e, quality::INT AS label FROM regions), l AS (SELECT doc_id::VARCHAR AS contig, length(text) AS n FROM documents)
SELECT m.contig, m.s AS start, label, substr(f.seq, m.s + 1, 200) AS sequence, count(p.id)::INT AS peaks FROM m JOIN reference f USING (contig)
  LEFT JOIN (SELECT id, contig, s // 50 * 50 AS lo, pe // 50 * 50 + 50 AS hi, n FROM dreads JOIN l USING (contig) WHERE cell_type = 'c1') p
  ON p.contig = m.contig AND p.lo < m.e AND m.s < p.hi AND m.s >= greatest(p.lo - 200, 0) AND m.s < least(p.hi + 200, n) GROUP BY ALL""",
        "document_regions", "document_reads", "reference",
    ),
)
def job_dataset(spark, d):
    """Labels to sequences to the peaks of their windows, written as text and read again."""
    from ..operators.sequences import chunked, extract_sequences

    labels = V.document_regions(spark, d).select("contig", "start", "end", F.lit("c1").alias("cell_type"), F.lit("EGR1").alias("tf"), F.col("quality").cast("int").alias("label"))
    peaks = V.document_reads(spark, d).filter("cell_type = 'c1'").select("contig", "start", F.col("peak_end").alias("end"), "cell_type")
    lengths = V.reference(spark, d).select("contig", F.length("seq").cast("long").alias("length"))
    found = I.peak_counts(extract_sequences(labels, chunked(V.reference(spark, d))), peaks, lengths)
    path = shared_path(spark, "dataset")
    W.write_windows(found.withColumn("dnase", F.array().cast("array<double>")), path, text=True)
    return R.scan_windows(spark, path).select("contig", "start", "label", "sequence", F.col("dnase_peak_count").alias("peaks"))


@query("job_sequences", sql(", rg AS (SELECT doc_id::VARCHAR AS contig, CASE WHEN quality = 1 THEN 1 WHEN doc_id % 7 = 0 THEN -1 ELSE 0 END AS label FROM labels) SELECT rg.contig, label, substr(seq, 51, 100) AS sequence FROM rg JOIN reference USING (contig)", "reference"))
def job_sequences(spark, d):
    """Labelled regions with their sequence."""
    from ..functions.labels import label_encode
    from ..operators.sequences import chunked, extract_sequences

    text = F.when(F.col("quality") == 1, "B").when(F.col("doc_id") % 7 == 0, "A").otherwise("U")
    labels = V.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("contig"), F.lit(50).cast("long").alias("start"), F.lit(150).cast("long").alias("end"), label_encode(text).alias("label"))
    return extract_sequences(labels, chunked(V.reference(spark, d))).select("contig", "label", "sequence")
