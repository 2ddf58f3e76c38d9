"""Queries over labels, splits, metrics and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import metrics as M, ranking as R, splits as P
from . import views as V
from .registry import query
from .views import sql

_R6 = lambda df, *keep: df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])

#: Cumulative counts at distinct scores, by an optional key k.
_CURVE = """, t AS (SELECT k, score, sum((label = 1)::INT) AS pos, count(*) AS al FROM rows GROUP BY k, score),
c AS (SELECT k, score, pos, al, sum(pos) OVER w AS tp, sum(al - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY k) AS p, sum(al - pos) OVER (PARTITION BY k) AS n FROM t WINDOW w AS (PARTITION BY k ORDER BY score DESC)),
d AS (SELECT *, tp / (tp + fp)::DOUBLE AS prec, CASE WHEN p = 0 THEN 0 ELSE tp / p::DOUBLE END AS rec, CASE WHEN n = 0 THEN 0 ELSE fp / n::DOUBLE END AS fpr,
  CASE WHEN p = 0 THEN 0 ELSE (tp - pos) / p::DOUBLE END AS prec0_rec, CASE WHEN n = 0 THEN 0 ELSE (fp - al + pos) / n::DOUBLE END AS fpr0,
  CASE WHEN tp + fp = al THEN NULL ELSE (tp - pos) / (tp + fp - al)::DOUBLE END AS prec0 FROM c)"""
_ROC = "round(sum((fpr - fpr0) * (rec + prec0_rec) / 2), 6)::DOUBLE"
_PRC = "round(sum((rec - prec0_rec) * (prec + coalesce(prec0, prec)) / 2), 6)::DOUBLE"
_AP = "round(sum((rec - prec0_rec) * prec), 6)::DOUBLE"
_FDR = lambda cut: f"round(coalesce(max(rec) FILTER (1 - prec <= {cut}), 0), 6)::DOUBLE"
_ROWS = ", rows AS (SELECT 1 AS k, label, score FROM scored)"


@query("label_encode", "SELECT doc_id, CASE WHEN quality = 1 THEN 1 WHEN doc_id % 7 = 0 THEN -1 ELSE 0 END AS label FROM labels")
def label_encode(spark, d):
    t = V.table(spark, d, "labels")
    text = F.when(F.col("quality") == 1, "B").when(F.col("doc_id") % 7 == 0, "A").otherwise("U")
    return t.select("doc_id", L.label_encode(text).alias("label"))


@query("normalize_cell_type", "SELECT o_orderkey, replace(replace(o_orderpriority, '-', ''), '_', '') AS cell_type FROM orders WHERE o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '5-%'")
def normalize_cell_type(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", L.plain_cell_type(F.col("o_orderpriority")).alias("cell_type"))
    known = o.select("cell_type").distinct().filter("cell_type like '1%' or cell_type like '5%'")
    return o.join(known, "cell_type", "left_semi").select("o_orderkey", "cell_type")


@query("valid_chromosomes", "SELECT doc_id FROM (SELECT doc_id, 'chr' || (doc_id % 30) AS c FROM documents) WHERE c IN (SELECT 'chr' || i FROM range(1, 23) t(i))")
def valid_chromosomes(spark, d):
    docs = V.table(spark, d, "documents").withColumn("contig", F.concat(F.lit("chr"), (F.col("doc_id") % 30).cast("string")))
    return docs.filter(F.col("contig").isin(list(L.CHROMOSOMES))).select("doc_id")


@query("drop_cell_type", sql("SELECT id FROM reads WHERE cell_type <> 'c2'", "reads"))
def drop_cell_type(spark, d):
    return V.reads(spark, d).filter(F.col("cell_type") != "c2").select("id")


@query("drop_ambiguous", sql("SELECT contig, s AS start, q AS label FROM wide WHERE q >= 0", "wide"))
def drop_ambiguous(spark, d):
    w = V.wide_labels(spark, d)
    return w.select(F.col("chr").alias("contig"), "start", L.label_encode(F.col("HepG2")).alias("label")).filter("label >= 0")


@query("cell_type_ids", sql("SELECT id, (substr(cell_type, 2)::INT) AS cell_id FROM reads", "reads"))
def cell_type_ids(spark, d):
    r = V.reads(spark, d)
    ids = r.select("cell_type").distinct().withColumn("cell_id", F.substring("cell_type", 2, 9).cast("int"))
    return r.join(ids, "cell_type").select("id", "cell_id")


@query("parse_submission_name", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'F' WHEN 2 THEN 'B' END AS board, CASE WHEN o_orderkey % 4 < 3 THEN o_orderstatus END AS tf, CASE WHEN o_orderkey % 4 < 3 THEN 'k' || (o_custkey % 9) END AS cell_type FROM orders")
def parse_submission_name(spark, d):
    board = F.when(F.col("o_orderkey") % 4 == 0, "L").when(F.col("o_orderkey") % 4 == 1, "F").when(F.col("o_orderkey") % 4 == 2, "B").otherwise("X")
    name = F.concat(F.lit("/out/"), board, F.lit("."), "o_orderstatus", F.lit(".k"), (F.col("o_custkey") % 9).cast("string"), F.lit(".tab.gz"))
    return V.table(spark, d, "orders").select("o_orderkey", L.submission_name(name).alias("s")).select("o_orderkey", "s.board", "s.tf", "s.cell_type")




@query("minmax_scale", sql(", b AS (SELECT min(score) AS lo, max(score) AS hi FROM scored) SELECT id, round((score - lo) / (hi - lo), 6) AS scaled FROM scored, b", "scored"))
def minmax_scale(spark, d):
    return M.minmax_scale(V.scored(spark, d), "score").select("id", F.round("scaled", 6).alias("scaled"))


@query("submission_projection", sql(", b AS (SELECT min(score) AS lo, max(score) AS hi FROM scored) SELECT CASE WHEN id % 25 = 0 THEN 24 WHEN id % 25 = 24 THEN 25 ELSE id % 25 END::INT AS chromosome, id, round((score - lo) / (hi - lo), 6) AS prob FROM scored, b", "scored"))
def submission_projection(spark, d):
    contig = F.concat(F.lit("chr"), F.when(F.col("id") % 25 == 0, "X").when(F.col("id") % 25 == 24, "Y").otherwise((F.col("id") % 25).cast("string")))
    rows = M.minmax_scale(V.scored(spark, d), "score").select(L.submission_chromosome(contig).alias("chromosome"), "id", F.round("scaled", 6).alias("prob"))
    return rows.orderBy("chromosome", "id")


@query("binary_metrics", sql(f"{_ROWS}{_CURVE} SELECT {_PRC} AS auprc, {_ROC} AS auroc FROM d", "scored"))
def binary_metrics(spark, d):
    return _R6(M.binary_metrics(V.scored(spark, d)))


@query("recall_at_fdr", sql(f"{_ROWS}{_CURVE} SELECT {_FDR(0.5)} AS recall_at_50_fdr, {_FDR(0.1)} AS recall_at_10_fdr FROM d", "scored"))
def recall_at_fdr(spark, d):
    return _R6(M.recall_at_fdr(V.scored(spark, d), (0.5, 0.1)))


@query("pr_auc_trapezoid", sql(f"{_ROWS}{_CURVE} SELECT {_PRC} AS auprc FROM d", "scored"))
def pr_auc_trapezoid(spark, d):
    return M.curves(V.scored(spark, d)).agg(F.round(M.au_prc(), 6).alias("auprc"))


@query("tagged_metrics", sql(f", rows AS (SELECT 1 AS k, toxic AS label, score FROM scored){_CURVE} SELECT {_AP} AS val_ap, {_ROC} AS val_auroc, {_FDR(0.5)} AS val_recall_at_50_fdr, {_FDR(0.25)} AS val_recall_at_25_fdr, {_FDR(0.1)} AS val_recall_at_10_fdr, {_FDR(0.05)} AS val_recall_at_5_fdr FROM d", "scored"))
def tagged_metrics(spark, d):
    return _R6(M.tagged_metrics(V.scored(spark, d).withColumn("label", F.col("toxic")), "val"))


@query(
    "classification_report",
    sql(
        f"""{_ROWS}{_CURVE}, x AS (SELECT sum(pos) FILTER (score > 0.5) AS tp, sum(al) FILTER (score > 0.5) AS pred, sum(pos) AS p, sum(al - pos) AS n FROM d)
SELECT x.tp::BIGINT AS tp, x.p::BIGINT AS p, (x.n - (pred - x.tp))::BIGINT AS tn, x.n::BIGINT AS n, {_ROC} AS auroc, {_PRC} AS auprc, round(2.0::DOUBLE * x.tp / (pred + x.p), 6) AS f1,
  {_FDR(0.5)} AS recall_at_50_fdr, {_FDR(0.25)} AS recall_at_25_fdr, {_FDR(0.1)} AS recall_at_10_fdr, {_FDR(0.05)} AS recall_at_5_fdr,
  round(x.tp / (x.p + 0.000001::DOUBLE), 6) AS positive_accuracy, round((x.n - (pred - x.tp)) / (x.n + 0.000001::DOUBLE), 6) AS negative_accuracy,
  round((x.tp / (x.p + 0.000001::DOUBLE) + (x.n - (pred - x.tp)) / (x.n + 0.000001::DOUBLE)) / 2, 6) AS balanced_accuracy FROM d, x GROUP BY x.tp, x.p, x.n, pred""",
        "scored",
    ),
)
def classification_report(spark, d):
    return _R6(M.classification_report(V.scored(spark, d)), "tp", "p", "tn", "n")


@query("bootstrap_metrics", sql(f", rows AS (SELECT ((row_number() OVER (PARTITION BY label ORDER BY id) - 1) % 10)::INT AS k, label, score FROM scored){_CURVE} SELECT k AS fold, {_AP} AS ap, {_ROC} AS auroc FROM d GROUP BY k", "scored"))
def bootstrap_metrics(spark, d):
    return _R6(M.bootstrap_metrics(V.scored(spark, d)), "fold")


@query("class_counts", sql("SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM scored", "scored"))
def class_counts(spark, d):
    return M.class_counts(V.scored(spark, d))


@query("missed_counts", sql("SELECT count(*) FILTER (label = 1 AND score <= 0.6) AS false_negatives, count(*) FILTER (label = 0 AND score > 0.6) AS false_positives FROM scored", "scored"))
def missed_counts(spark, d):
    return M.missed_counts(V.scored(spark, d).withColumn("prediction", (F.col("score") > 0.6).cast("int")))


@query("synthetic_scores", sql("SELECT CASE WHEN id % 3 = 0 THEN -1 ELSE label END AS label, count(*) AS n, 0::BIGINT AS outside FROM scored GROUP BY 1", "scored"))
def synthetic_scores(spark, d):
    """By label: the number of scores, and how many lie outside the label's range (none)."""
    label = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("label"))
    s = M.synthetic_scores(V.scored(spark, d).drop("score").withColumn("label", label), "id")
    low, high = F.when(F.col("label") == 0, 0.0).when(F.col("label") == -1, 0.5).otherwise(0.7), F.when(F.col("label") == 0, 0.8).when(F.col("label") == -1, 0.9).otherwise(1.0)
    return s.groupBy("label").agg(F.count("*").alias("n"), F.count_if((F.col("score") < low) | (F.col("score") > high)).alias("outside"))


# --- splits ----------------------------------------------------------------------------

_SPLIT = "CASE WHEN cell_type = 'c1' AND contig IN ('chr2', 'chr3') THEN '{}' WHEN cell_type <> 'c1' AND contig NOT IN ('chr2', 'chr3'){} THEN 'train' END"


@query("holdout_split", sql(f"SELECT id, {_SPLIT.format('test', '')} AS split FROM features", "features"))
def holdout_split(spark, d):
    return P.holdout(V.features(spark, d), ["c1"], ["chr2", "chr3"]).select("id", "split")


@query("train_val_split", sql(f", f AS (SELECT id, cell_type, contig, CASE WHEN id % 5 = 0 THEN -1 ELSE label END AS label FROM features) SELECT id, {_SPLIT.format('val', ' AND label <> -1')} AS split FROM f", "features"))
def train_val_split(spark, d):
    f = V.features(spark, d).withColumn("label", F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("label")))
    return P.train_val(f, ["c1"], ["chr2", "chr3"]).select("id", "split")


_HASH = lambda text: f"('0x' || substr(md5({text}), 1, 8))::BIGINT"
_DEAL = lambda kind, n: f"""SELECT fold, '{kind}' AS kind, value FROM (SELECT fold, value, row_number() OVER (PARTITION BY fold ORDER BY {_HASH(f"'{kind}:' || value || ':' || fold")}, value) AS r FROM (SELECT DISTINCT {kind} AS value FROM features), (SELECT unnest(range(0, 4))::INT AS fold)) WHERE r <= {n}"""


@query("holdout_folds", sql(f"{_DEAL('cell_type', 1)} UNION ALL {_DEAL('contig', 2)}", "features"))
def holdout_folds(spark, d):
    return P.holdout_folds(V.features(spark, d), 1, 2, 4)




@query("hash_folds", sql(f"SELECT id, contig, ({_HASH('contig')} % 3)::INT AS fold FROM features", "features"))
def hash_folds(spark, d):
    return V.features(spark, d).select("id", "contig", P.hash_fold(F.col("contig"), 3).alias("fold"))


@query("sample_negatives", sql(f"SELECT label, count(*) AS n FROM features WHERE label = 1 OR (label = 0 AND {_HASH("'0:' || id")} < {int(0.3 * 2**32)}) GROUP BY label", "features"))
def sample_negatives(spark, d):
    return P.sample_negatives(V.features(spark, d), 0.3, "id").groupBy("label").agg(F.count("*").alias("n"))


@query("sample_negatives_unseeded", sql(f"SELECT id, label FROM features WHERE label = 1 OR (label = 0 AND {_HASH("'9:' || id")} < {int(0.5 * 2**32)})", "features"))
def sample_negatives_unseeded(spark, d):
    """The same operator: a seed is always given."""
    return P.sample_negatives(V.features(spark, d), 0.5, "id", seed=9).select("id", "label")


@query("sample_negatives_all", sql("SELECT label, count(*) AS n FROM features WHERE label IN (0, 1) GROUP BY label", "features"))
def sample_negatives_all(spark, d):
    """At rate 1 the sample is everything labelled."""
    return P.sample_negatives(V.features(spark, d), 1.0, "id").groupBy("label").agg(F.count("*").alias("n"))


@query("sample_rows", sql(f"SELECT id FROM features WHERE {_HASH("'5:' || id")} < {int(0.2 * 2**32)}", "features"))
def sample_rows(spark, d):
    return P.sample_rows(V.features(spark, d), 0.2, "id", seed=5).select("id")


# --- ranks -----------------------------------------------------------------------------

_AVG = lambda col, keys, desc="DESC": f"(rank() OVER (PARTITION BY {keys} ORDER BY {col} {desc}) + (count(*) OVER (PARTITION BY {keys}, {col}) - 1) / 2.0::DOUBLE)"


@query("avg_rank", sql(f"SELECT id, {_AVG('m0', 'tf, sample')} AS rank FROM submissions", "submissions"))
def avg_rank(spark, d):
    return R.average_ranks(V.submissions(spark, d).select("id", "tf", "sample", "m0"), "m0", ["tf", "sample"]).select("id", "rank")


_BOARD = """, u AS (SELECT "user", tf, sample, bootstrap, m0, m1, m2, m3 FROM submissions QUALIFY row_number() OVER (PARTITION BY "user", tf, sample, bootstrap ORDER BY id DESC) = 1)"""
_B = "tf, sample, bootstrap"
_COMBINED = f"""{_BOARD}, cs AS (SELECT *, count(*) OVER (PARTITION BY {_B}) AS n, round({' + '.join(f"ln({_AVG(f'm{i}', _B)} / (count(*) OVER (PARTITION BY {_B}) + 1))" for i in range(4))}, 9) AS rank_sum FROM u),
cr AS (SELECT *, {_AVG('rank_sum', _B, 'ASC')} AS combined_rank FROM cs)"""


@query("combined_rank", sql(f"{_COMBINED} SELECT \"user\", tf, sample, bootstrap, round(rank_sum, 6) AS rank_sum, combined_rank FROM cr", "submissions"))
def combined_rank(spark, d):
    out = R.combined_rank(V.one_per_board(spark, d), ["m0", "m1", "m2", "m3"], ["tf", "sample", "bootstrap"])
    return out.select("user", "tf", "sample", "bootstrap", F.round("rank_sum", 6).alias("rank_sum"), "combined_rank")


@query("latest_per_user", sql('SELECT "user", id, m0 FROM submissions QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY date DESC, id DESC) = 1', "submissions"))
def latest_per_user(spark, d):
    return R.latest_per_user(V.submissions(spark, d), "user", "date", "id").select("user", "id", "m0")


@query(
    "global_ranking",
    sql(
        f"""{_COMBINED}, sc AS (SELECT "user", {_B}, least(0.5, combined_rank / (n + 1)) AS s FROM cr),
bd AS (SELECT DISTINCT {_B} FROM u), us AS (SELECT DISTINCT "user" FROM u),
tt AS (SELECT us."user", bd.bootstrap, round(sum(coalesce(s, 0.5)), 9) AS total FROM us CROSS JOIN bd LEFT JOIN sc ON sc."user" = us."user" AND sc.tf = bd.tf AND sc.sample = bd.sample AND sc.bootstrap = bd.bootstrap GROUP BY ALL),
rk AS (SELECT *, {_AVG('total', 'bootstrap', 'ASC')} AS r FROM tt)
SELECT "user", round(min(total), 6)::DOUBLE AS min_score, round(avg(total), 6)::DOUBLE AS mean_score, round(max(total), 6)::DOUBLE AS max_score, list_sort(list(r))[least(2, count(*))] AS second_rank FROM rk GROUP BY "user\"""",
        "submissions",
    ),
)
def global_ranking(spark, d):
    out = R.global_ranking(V.one_per_board(spark, d), ["m0", "m1", "m2", "m3"])
    return out.select("user", *[F.round(c, 6).alias(c) for c in ("min_score", "mean_score", "max_score")], "second_rank")


@query("template_left_join", sql(", p AS (SELECT contig, s, q::DOUBLE AS score FROM wide WHERE s % 100 = 0) SELECT w.contig, w.s AS start, coalesce(score, 0.0) AS score, (score IS NULL)::INT AS missing FROM wide w LEFT JOIN p ON w.contig = p.contig AND w.s = p.s", "wide"))
def template_left_join(spark, d):
    w = V.wide_labels(spark, d).select(F.col("chr").alias("contig"), "start", F.col("stop").alias("end"), L.label_encode(F.col("HepG2")).alias("label"))
    p = w.filter("start % 100 = 0").select("contig", "start", "end", F.col("label").cast("double").alias("score"))
    return R.template_join(w.drop("label"), p).select("contig", "start", "score", "missing")


@query("aligned_join_check", sql("SELECT count(*) FILTER (s % 100 <> 0) AS only_truth, 0::BIGINT AS only_submission, count(*) FILTER (s % 100 = 0 AND s % 300 = 0) AS bad_scores, 0::BIGINT AS bad_labels FROM wide", "wide"))
def aligned_join_check(spark, d):
    w = V.wide_labels(spark, d).select(F.col("chr").alias("contig"), "start", F.col("stop").alias("end"), F.col("HepG2").alias("label"))
    score = F.when(F.col("start") % 300 == 0, "x").otherwise("0.5")
    return R.aligned_check(w, w.filter("start % 100 = 0").withColumn("score", score))


@query("board_order", sql("SELECT contig, s AS start FROM wide WHERE contig IN ('chr1', 'chr3') ORDER BY contig, s", "wide"))
def board_order(spark, d):
    w = V.wide_labels(spark, d).select(F.col("chr").alias("contig"), "start", F.col("stop").alias("end"))
    return R.board_order(w, contigs=("chr1", "chr3")).select("contig", "start")


@query("first_n_per_file", sql("SELECT file, id FROM reads QUALIFY row_number() OVER (PARTITION BY file ORDER BY id) <= 50", "reads"))
def first_n_per_file(spark, d):
    return R.first_n(V.reads(spark, d), 50, ["file"], ["id"]).select("file", "id")


@query("arg_max_class", sql("SELECT id, (score > 1 - score)::INT AS class FROM scored", "scored"))
def arg_max_class(spark, d):
    from ..operators.models import arg_max_class as pick

    return V.scored(spark, d).select("id", pick(1 - F.col("score"), F.col("score")).alias("class"))
