"""Queries over windows, joins and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import has_signal
from ..operators import coverage as C, intervals as I
from . import views as V
from .registry import query
from .views import sql

_GRID = """grid AS (SELECT id, contig, cell_type, s, e, unnest(range(greatest(s // 50 * 50 - 200, 0), least(e // 50 * 50 + 250, 43200), 50)) AS w FROM peaks),
win AS (SELECT * FROM grid WHERE w < e // 50 * 50 + 50 AND w + 200 > s // 50 * 50)"""


@query("contig_lengths", sql("SELECT contig, length(seq)::BIGINT AS length FROM reference WHERE length(seq) > 0", "reference"))
def contig_lengths(spark, d):
    from ..operators.sequences import chunked

    return I.contig_lengths(chunked(V.reference(spark, d)))


@query("snap_to_grid", sql("SELECT id, s // 50 * 50 AS low, e // 50 * 50 + 50 AS high FROM peaks", "peaks"))
def snap_to_grid(spark, d):
    low, high = I.snap(F.col("start"), F.col("end"))
    return V.peaks(spark, d).select("id", low.alias("low"), high.alias("high"))


@query("sliding_windows", sql(f", {_GRID} SELECT id, w AS win_start, w + 200 AS win_end FROM win", "peaks"))
def sliding_windows(spark, d):
    return I.sliding_windows(V.peaks(spark, d), V.lengths(spark, d)).select("id", "win_start", "win_end")


@query("sliding_windows_exact", sql(f", {_GRID} SELECT id, w AS win_start, w + 200 AS win_end FROM grid WHERE w < e AND w + 200 > s", "peaks"))
def sliding_windows_exact(spark, d):
    return I.sliding_windows(V.peaks(spark, d), V.lengths(spark, d), exact=True).select("id", "win_start", "win_end")


@query("window_collect", sql(f", {_GRID} SELECT contig, cell_type, w AS win_start, count(*) AS n, min(id) AS first_id, sum(id)::BIGINT AS ids FROM win GROUP BY ALL", "peaks"))
def window_collect(spark, d):
    out = I.window_collect(V.peaks(spark, d), V.lengths(spark, d), ["cell_type"], "id")
    return out.select("contig", "cell_type", "win_start", "n", F.element_at("values", 1).alias("first_id"), F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))


@query(
    "peak_count_join",
    sql(f", {_GRID} SELECT a.contig, a.s AS win_start, a.cell_type, coalesce(n, 0) AS dnase_peak_count FROM (SELECT contig, s, cell_type FROM windows, (SELECT DISTINCT cell_type FROM peaks)) a LEFT JOIN (SELECT contig, cell_type, w, count(*) AS n FROM win GROUP BY ALL) b ON a.contig = b.contig AND a.cell_type = b.cell_type AND a.s = b.w", "windows", "peaks"),
)
def peak_count_join(spark, d):
    peaks = V.peaks(spark, d)
    windows = V.windows(spark, d).withColumn("cell_type", F.explode(F.array(*[F.lit(f"c{i}") for i in range(3)])))
    return I.peak_counts(windows, peaks, V.lengths(spark, d)).select("contig", F.col("start").alias("win_start"), "cell_type", "dnase_peak_count")


@query(
    "full_outer_windows",
    sql(f", {_GRID} SELECT contig, w AS win_start, cell_type, count(*) FILTER (signal < 50) AS left_n, count(*) FILTER (signal > 200) AS right_n FROM win JOIN (SELECT id, signal FROM peaks) USING (id) WHERE signal < 50 OR signal > 200 GROUP BY ALL", "peaks"),
)
def full_outer_windows(spark, d):
    p = V.peaks(spark, d)
    out = I.full_outer_windows(p.filter("signal < 50"), p.filter("signal > 200"), V.lengths(spark, d), "cell_type")
    return out.select("contig", "win_start", "cell_type", F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))


@query(
    "motif_hit_join",
    sql(f", {_GRID} SELECT a.contig, a.s AS win_start, coalesce(n, 0) AS hits, coalesce(ids, 0) AS ids FROM windows a LEFT JOIN (SELECT contig, w, count(*) AS n, sum(id)::BIGINT AS ids FROM win WHERE cell_type = 'c1' GROUP BY ALL) b ON a.contig = b.contig AND a.s = b.w", "windows", "peaks"),
)
def motif_hit_join(spark, d):
    hits = V.peaks(spark, d).filter("cell_type = 'c1'").withColumnRenamed("cell_type", "tf")
    found = I.window_collect(hits, V.lengths(spark, d), ["tf"], "id").select("contig", F.col("win_start").alias("start"), "tf", "values")
    out = V.windows(spark, d).withColumn("tf", F.lit("c1")).join(found, ["contig", "start", "tf"], "left")
    ids = F.coalesce(F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    return out.select("contig", F.col("start").alias("win_start"), F.coalesce(F.size("values"), F.lit(0)).cast("long").alias("hits"), ids.alias("ids"))


@query("overlap_join_inner", sql("SELECT p.id, r.id AS r_id FROM peaks p JOIN reads r ON p.contig = r.contig AND p.cell_type = r.cell_type AND p.s < r.e AND r.s < p.e AND p.s < p.e AND r.s < r.e", "peaks", "reads"))
def overlap_join_inner(spark, d):
    reads = V.reads(spark, d).select("id", "contig", "cell_type", "start", "end")
    return I.overlap_join(V.peaks(spark, d).drop("signal"), reads, ["cell_type"]).select("id", "r_id")


@query("overlap_join_left", sql("SELECT p.id, r.id AS r_id FROM peaks p LEFT JOIN reads r ON p.contig = r.contig AND p.cell_type = r.cell_type AND p.s < r.e AND r.s < p.e AND p.s < p.e AND r.s < r.e", "peaks", "reads"))
def overlap_join_left(spark, d):
    reads = V.reads(spark, d).select("id", "contig", "cell_type", "start", "end")
    return I.overlap_join(V.peaks(spark, d).drop("signal"), reads, ["cell_type"], "left").select("id", "r_id")


@query(
    "near_positive_semijoin",
    sql(
        """, l AS (SELECT *, CASE WHEN signal > 60 THEN 1 WHEN signal < 20 THEN 0 ELSE -1 END AS label FROM peaks)
SELECT id, label FROM l WHERE label = 1 UNION ALL
SELECT id, label FROM l n WHERE label = 0 AND EXISTS (SELECT 1 FROM l p WHERE p.label = 1 AND p.contig = n.contig AND p.cell_type = n.cell_type
  AND greatest(0, greatest(n.s - p.e, p.s - n.e) + 1) > 200 AND greatest(0, greatest(n.s - p.e, p.s - n.e) + 1) < 700)""",
        "peaks",
    ),
)
def near_positive_semijoin(spark, d):
    label = F.when(F.col("signal") > 60, 1).when(F.col("signal") < 20, 0).otherwise(-1)
    return I.near_positives(V.peaks(spark, d).withColumn("label", label), ["cell_type"]).select("id", "label")


@query("generate_cuts", sql("SELECT id, s AS start FROM cuts", "reads", "cuts"))
def generate_cuts(spark, d):
    return C.cuts(V.reads(spark, d)).select("id", "start")


@query("valid_reads", sql("SELECT id FROM reads WHERE contig IS NOT NULL AND s >= 0", "reads"))
def valid_reads(spark, d):
    from ..functions.labels import valid_read

    return V.reads(spark, d).filter(valid_read(F.col("contig"), F.col("start"))).select("id")


@query("strand_coverage", sql("SELECT contig, s AS start, s + 1 AS \"end\", strand, round(count(*) / (SELECT count(DISTINCT file) FROM cuts)::DOUBLE, 6) AS count FROM cuts GROUP BY contig, s, strand", "reads", "cuts"))
def strand_coverage(spark, d):
    return C.strand_coverage(C.cuts(V.reads(spark, d))).withColumn("count", F.round("count", 6))


@query("split_strand", sql("SELECT strand, count(*) AS n FROM reads GROUP BY strand", "reads"))
def split_strand(spark, d):
    r = V.reads(spark, d)
    both = C.tag_strand(C.split_strand(r, "+").drop("strand"), C.split_strand(r, "-").drop("strand"))
    return both.groupBy("strand").agg(F.count("*").alias("n"))


@query("tag_strand", sql("SELECT id, strand FROM reads", "reads"))
def tag_strand(spark, d):
    r = V.reads(spark, d)
    return C.tag_strand(C.split_strand(r, "+").drop("strand"), C.split_strand(r, "-").drop("strand")).select("id", "strand")


_CUTWIN = "cutwin AS (SELECT contig, strand, s, unnest(range(greatest(0, (s - 199 + 49) // 50 * 50), s + 1, 50)) AS w FROM cuts WHERE s >= 199 UNION ALL SELECT contig, strand, s, unnest(range(0, s + 1, 50)) AS w FROM cuts WHERE s < 199 AND s >= 0)"


def _pile(spark, d):
    hits = C.cut_windows(C.cuts(V.reads(spark, d))).withColumn("one", F.lit(1))
    return C.pileup(hits, ["contig", "win_start"], "one")


@query(
    "pileup_counts",
    sql(f", {_CUTWIN} SELECT contig, w AS win_start, sum(CASE WHEN strand = '+' THEN 1 ELSE 0 END)::DOUBLE AS plus, sum(CASE WHEN strand = '-' THEN 1 ELSE 0 END)::DOUBLE AS minus, sum((s - w + CASE WHEN strand = '-' THEN 200 ELSE 0 END))::DOUBLE AS moment FROM cutwin GROUP BY contig, w", "reads", "cuts"),
)
def pileup_counts(spark, d):
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v)
    moment = add(F.transform("dnase", lambda v, i: v * i))
    return _pile(spark, d).select("contig", "win_start", add(F.slice("dnase", 1, 200)).alias("plus"), add(F.slice("dnase", 201, 200)).alias("minus"), moment.alias("moment"))


@query(
    "pileup_vector",
    sql(
        """, cov AS (SELECT contig, s, s + 1 + (id % 5) AS e, strand, 1 + id % 3 AS v FROM reads)
, b AS (SELECT w.contig, w.s AS w, strand, v, unnest(range(greatest(c.s - w.s, 0), least(c.e - w.s, 200))) AS o FROM windows w JOIN cov c ON c.contig = w.contig AND c.s < w.e AND w.s < c.e)
SELECT contig, w AS win_start, sum(v)::DOUBLE AS total, sum(v * (o + CASE WHEN strand = '-' THEN 200 ELSE 0 END))::DOUBLE AS moment FROM b GROUP BY contig, w""",
        "windows", "reads",
    ),
)
def pileup_vector(spark, d):
    r = V.reads(spark, d)
    cover = r.select("contig", "start", (F.col("start") + 1 + F.col("id") % 5).alias("end"), "strand", (1 + F.col("id") % 3).alias("count"))
    pairs = I.overlap_join(V.windows(spark, d), cover)
    hits = C.covered_offsets(pairs).select("contig", F.col("start").alias("win_start"), F.col("r_strand").alias("strand"), "offset", F.col("r_count").alias("count"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v)
    return C.pileup(hits, ["contig", "win_start"], "count").select("contig", "win_start", add(F.col("dnase")).alias("total"), add(F.transform("dnase", lambda v, i: v * i)).alias("moment"))


@query(
    "multiscale_footprint",
    sql(
        f""", {_CUTWIN}, t AS (SELECT contig, w, count(*) FILTER (strand = '+')::DOUBLE AS total, count(*) FILTER (strand = '+' AND s - w < 100)::DOUBLE AS half,
  count(*) FILTER (strand = '+' AND s - w >= 100 AND s - w < 150)::DOUBLE AS q3, count(*) FILTER (strand = '+' AND s - w >= 100)::DOUBLE AS right_half, count(*) FILTER (strand = '-')::DOUBLE AS minus FROM cutwin GROUP BY contig, w)
SELECT contig, w AS win_start, 256 AS size, total, round(half / CASE WHEN total = 0 THEN 1 ELSE total END, 6) AS scale_1, round(q3 / CASE WHEN right_half = 0 THEN 1 ELSE right_half END, 6) AS scale_2, minus FROM t""",
        "reads", "cuts",
    ),
)
def multiscale_footprint(spark, d):
    f = C.with_footprint(_pile(spark, d))
    at = lambda i: F.round(F.element_at("features", i), 6)
    return f.select("contig", "win_start", F.size("features").alias("size"), at(1).alias("total"), at(2).alias("scale_1"), at(4).alias("scale_2"), at(129).alias("minus"))


@query("split_by_signal", sql(f", {_CUTWIN} SELECT has, count(*) AS n FROM (SELECT a.contig, a.s, max(b.w) IS NOT NULL AS has FROM windows a LEFT JOIN cutwin b ON a.contig = b.contig AND a.s = b.w GROUP BY ALL) GROUP BY has", "windows", "reads", "cuts"))
def split_by_signal(spark, d):
    signal = _pile(spark, d).select("contig", F.col("win_start").alias("start"), "dnase")
    return V.windows(spark, d).join(signal, ["contig", "start"], "left").groupBy(has_signal(F.col("dnase")).alias("has")).agg(F.count("*").alias("n"))


@query(
    "binary_signal_feature",
    sql(f", {_CUTWIN} SELECT a.contig, a.s AS win_start, CASE WHEN max(b.w) IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS feature FROM windows a LEFT JOIN cutwin b ON a.contig = b.contig AND a.s = b.w GROUP BY a.contig, a.s", "windows", "reads", "cuts"),
)
def binary_signal_feature(spark, d):
    from ..functions.labels import binary_signal

    signal = _pile(spark, d).select("contig", F.col("win_start").alias("start"), "dnase")
    return V.windows(spark, d).join(signal, ["contig", "start"], "left").select("contig", F.col("start").alias("win_start"), binary_signal(F.col("dnase")).alias("feature"))


@query("count_by_key", sql("SELECT contig, cell_type, count(*) AS n FROM reads GROUP BY ALL", "reads"))
def count_by_key(spark, d):
    return V.reads(spark, d).groupBy("contig", "cell_type").agg(F.count("*").alias("n"))


@query("distinct_keys", sql("SELECT DISTINCT contig, cell_type FROM reads", "reads"))
def distinct_keys(spark, d):
    return V.reads(spark, d).select("contig", "cell_type").distinct()


@query("sort_by_region", sql("SELECT contig, s AS start, e AS \"end\", id FROM peaks ORDER BY 1, 2, 3", "peaks"))
def sort_by_region(spark, d):
    return V.peaks(spark, d).orderBy("contig", "start", "end").select("contig", "start", "end", "id")


@query("union_all", sql("SELECT contig, s AS start FROM reads UNION ALL SELECT contig, s FROM peaks", "reads", "peaks"))
def union_all(spark, d):
    return V.reads(spark, d).select("contig", "start").unionByName(V.peaks(spark, d).select("contig", "start"))


@query("cross_product", "SELECT n.n_nationkey, r.r_regionkey FROM nation n, region r")
def cross_product(spark, d):
    """The one operator whose result is all pairs; both sides are fixed dimension tables here."""
    return V.table(spark, d, "nation").select("n_nationkey").crossJoin(V.table(spark, d, "region").select("r_regionkey"))


@query(
    "job_coverage",
    sql(
        f""", {_CUTWIN}, t AS (SELECT a.contig, a.s, count(b.w) FILTER (strand = '+') AS plus, count(b.w) FILTER (strand = '-') AS minus FROM windows a LEFT JOIN cutwin b ON a.contig = b.contig AND a.s = b.w GROUP BY ALL)
SELECT contig, s AS win_start, plus, minus, round((plus + minus) / (SELECT count(DISTINCT file) FROM cuts)::DOUBLE, 6) AS coverage FROM t""",
        "windows", "reads", "cuts",
    ),
)
def job_coverage(spark, d):
    """Reads to cuts to the coverage of every window of the grid."""
    cut = C.cuts(V.reads(spark, d))
    sums = C.cut_windows(cut).groupBy("contig", F.col("win_start").alias("start")).agg(F.count_if(F.col("strand") == "+").alias("plus"), F.count_if(F.col("strand") == "-").alias("minus"))
    out = V.windows(spark, d).join(sums, ["contig", "start"], "left").crossJoin(F.broadcast(cut.agg(F.count_distinct("file").alias("files"))))  # one row
    plus, minus = F.coalesce("plus", F.lit(0)), F.coalesce("minus", F.lit(0))
    return out.select("contig", F.col("start").alias("win_start"), plus.alias("plus"), minus.alias("minus"), F.round((plus + minus) / F.col("files"), 6).alias("coverage"))


@query("job_cuts", sql("SELECT cell_type, contig, strand, count(*) AS n, min(s) AS first, max(s) AS last FROM cuts GROUP BY ALL", "reads", "cuts"))
def job_cuts(spark, d):
    """Reads to cuts, written by cell type and read again."""
    from ..files import shared_path
    from ..sources.writers import write_cuts

    path = shared_path(spark, "cuts")
    write_cuts(C.cuts(V.reads(spark, d)), path)
    return spark.read.parquet(path).groupBy("cell_type", "contig", "strand").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("start").alias("last"))
