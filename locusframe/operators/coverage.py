"""Cuts, strand coverage and pile-up arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import valid_read
from ..functions.sequence import footprint, once
from .intervals import STRIDE, WINDOW


def cuts(reads: DataFrame) -> DataFrame:
    """Two one-base cuts a read: at both ends, on the minus strand one base before them."""
    back = F.when(F.col("strand") == "-", 1).otherwise(0)
    at = F.explode(F.array(F.col("start") - back, F.col("end") - back))
    keep = [c for c in reads.columns if c not in ("start", "end")]
    ok = reads.filter(valid_read(F.col("contig"), F.col("start")))
    return ok.select(*keep, at.alias("start")).withColumn("end", F.col("start") + 1)


def strand_coverage(cut: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cuts at each base and strand, divided by the number of distinct files (of the keys)."""
    keys = keys or []
    per = cut.groupBy(*keys, "contig", "start", "strand").agg(F.count("*").alias("n"))
    if keys:
        files = cut.groupBy(*keys).agg(F.count_distinct("file").alias("files"))
        both = per.join(files, keys)
    else:
        both = per.crossJoin(cut.agg(F.count_distinct("file").alias("files")))  # one row
    return both.select(*keys, "contig", "start", (F.col("start") + 1).alias("end"), "strand", (F.col("n") / F.col("files")).alias("count"))


def cut_windows(cut: DataFrame, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """One row for each grid window that holds a cut: win_start and offset; needs no join."""
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("start") - window + 1) / stride) * stride)
    last = F.floor(F.col("start") / stride) * stride
    starts = F.when(last >= first, F.sequence(first, last, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<long>"))
    return cut.filter("start >= 0").withColumn("win_start", F.explode(starts)).withColumn("offset", (F.col("start") - F.col("win_start")).cast("int"))


def sparse_pileup(hits: DataFrame, keys: list[str], value: str, window: int = WINDOW) -> DataFrame:
    """cuts: the numbers of pileup that are there, as a list of (place, v)."""
    place = F.col("offset") + F.when(F.col("strand") == "-", window).otherwise(0)
    sums = hits.withColumn("place", place).groupBy(*keys, "place").agg(F.sum(value).alias("v"))
    return sums.groupBy(*keys).agg(F.collect_list(F.struct("place", F.col("v").cast("double").alias("v"))).alias("cuts"))


def pileup(hits: DataFrame, keys: list[str], value: str, window: int = WINDOW) -> DataFrame:
    """dnase: window numbers of the plus strand, then of the minus strand, summed by offset.

    hits has the keys, strand, offset and value; the sums are made before the arrays, so a
    group has at most 2 * window rows.
    """
    grouped = sparse_pileup(hits, keys, value, window).select(*keys, F.map_from_entries("cuts").alias("m"))
    return grouped.select(*keys, once(F.transform(F.sequence(F.lit(0), F.lit(2 * window - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))).alias("dnase"))


def centered_pileup(windows: DataFrame, cut: DataFrame, motifs: DataFrame, window: int = WINDOW, footprint: bool = True) -> DataFrame:
    """contig, win_start, center and dnase: the pile-up of the window numbers around the best motif hit of each window.

    windows have contig, start, tf and sequence, cut has contig, start and strand.  Windows without a motif of their tf are
    centred in the middle; those without cuts have zeros.  With footprint the pile-up is taken at several scales.
    """
    from .intervals import overlap_join
    from .sequences import best_motif_center

    centers = best_motif_center(windows.select(F.struct("contig", "start").alias("id"), "tf", "sequence"), motifs)
    around = centers.select("id.contig", F.col("id.start").alias("win_start"), "center", (F.col("id.start") + F.col("center") - window // 2).alias("start"))
    around = around.withColumn("end", F.col("start") + window)
    pairs = overlap_join(around, cut.select("contig", "start", (F.col("start") + 1).alias("end"), "strand"))
    hits = pairs.select("contig", "win_start", F.col("r_strand").alias("strand"), (F.col("r_start") - F.col("start")).cast("int").alias("offset"), F.lit(1).alias("one"))
    out = around.select("contig", "win_start", "center").join(pileup(hits, ["contig", "win_start"], "one", window), ["contig", "win_start"], "left")
    out = out.withColumn("dnase", F.coalesce("dnase", F.array_repeat(F.lit(0.0), 2 * window)))
    return with_footprint(out) if footprint else out


def covered_offsets(pairs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Bases of joined coverage (r_start, r_end) clipped to the window, one row per offset."""
    low = F.greatest(F.col("r_start") - F.col("start"), F.lit(0))
    high = F.least(F.col("r_end") - F.col("start"), F.lit(window)) - 1
    return pairs.filter(high >= low).withColumn("offset", F.explode(F.sequence(low.cast("int"), high.cast("int"))))


def split_strand(df: DataFrame, strand: str) -> DataFrame:
    return df.filter(F.col("strand") == strand)


def tag_strand(plus: DataFrame, minus: DataFrame) -> DataFrame:
    """Bag union of both strands with a strand column."""
    return plus.withColumn("strand", F.lit("+")).unionByName(minus.withColumn("strand", F.lit("-")))


def with_footprint(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """features: the multiscale footprint of the plus half, then of the minus half of dnase."""
    halves = df.select(*df.columns, once(F.array(F.slice("dnase", 1, window), F.slice("dnase", window + 1, window))).alias("__h"))
    halves = halves.select(*df.columns, once(F.get("__h", F.lit(0))).alias("__p"), "__h").select("*", once(F.get("__h", F.lit(1))).alias("__m"))
    return halves.select(*df.columns, F.concat(footprint(F.col("__p")), footprint(F.col("__m"))).alias("features"))
