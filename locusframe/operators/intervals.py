"""Grid windows, overlap joins and distance joins over half-open intervals.

Intervals are flat columns contig, start, end.  Joins on overlap put both sides into bins of
several widths and meet on (contig, width, bin), so they plan as equi-joins; a pair is given by the
first bin that both share and therefore once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Fixed grid of the windows.
WINDOW, STRIDE = 200, 50


def contig_lengths(chunks: DataFrame) -> DataFrame:
    """contig and length of a chunk table (contig, chunk_start, seq)."""
    return chunks.groupBy("contig").agg(F.max(F.col("chunk_start") + F.length("seq")).cast("long").alias("length"))


def snap(start: Column, end: Column, stride: int = STRIDE) -> tuple[Column, Column]:
    """Bounds on the grid: the start moves down, the end down and one stride up."""
    return F.floor(start / stride) * stride, F.floor(end / stride) * stride + stride


def sliding_windows(df: DataFrame, lengths: DataFrame, window: int = WINDOW, stride: int = STRIDE, exact: bool = False) -> DataFrame:
    """One row per grid window that the snapped interval touches, as win_start and win_end.

    Windows start from max(start - window, 0) up to min(end + window, contig length),
    exclusive.  exact keeps only windows that overlap the interval itself.  Intervals of
    contigs without a length give no row.
    """
    low, high = snap(F.col("start"), F.col("end"), stride)
    df = df.join(lengths, "contig").withColumns({"__low": low, "__high": high})
    stop = F.least(F.col("__high") + window, F.col("length"))
    first = F.greatest(F.col("__low") - window, F.lit(0))
    starts = F.when(stop > first, F.sequence(first, stop - 1, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<long>"))
    a, b = ("start", "end") if exact else ("__low", "__high")
    hit = F.filter(starts, lambda s: (s < F.col(b)) & (s + window > F.col(a)))
    out = df.withColumn("win_start", F.explode(hit)).withColumn("win_end", F.col("win_start") + window)
    return out.drop("__low", "__high", "length")


def window_collect(df: DataFrame, lengths: DataFrame, keys: list[str], value: str, exact: bool = False) -> DataFrame:
    """Records of each grid window and key: n and the sorted values."""
    return (
        sliding_windows(df, lengths, exact=exact)
        .groupBy("contig", "win_start", "win_end", *keys)
        .agg(F.count("*").alias("n"), F.sort_array(F.collect_list(value)).alias("values"))
    )


def peak_counts(windows: DataFrame, peaks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Windows (contig, start, end, cell_type) with the number of peaks of their cell type in them, 0 if none."""
    n = sliding_windows(peaks, lengths).groupBy("contig", "cell_type", "win_start", "win_end").agg(F.count("*").alias("dnase_peak_count"))
    n = n.select("contig", "cell_type", F.col("win_start").alias("start"), F.col("win_end").alias("end"), "dnase_peak_count")
    return windows.join(n, ["contig", "start", "end", "cell_type"], "left").withColumn("dnase_peak_count", F.coalesce("dnase_peak_count", F.lit(0)))


def full_outer_windows(left: DataFrame, right: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """Counts of both sides in each grid window and key, with windows that only one side has."""
    count = lambda df, name: sliding_windows(df, lengths).groupBy("contig", "win_start", key).agg(F.count("*").alias(name))
    return count(left, "left_n").join(count(right, "right_n"), ["contig", "win_start", key], "full")


#: Rows of equal keys and bounds that meet as one.
TOGETHER = 4096
#: Bins of the first level, and how many times as wide each next one is.
BIN, WIDER, LEVELS = 1000, 8, 12
#: A bin is hot if it has more rows of a side than this, and than one in HOT_SHARE of all, so that few bins are.
HOT_ROWS, HOT_SHARE = 20_000, 2000


def _level(length: Column, bin_size: int) -> Column:
    """The first level whose bins are as wide as the interval, which then touches two of them at most."""
    out = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        out = F.when(length <= bin_size * WIDER**k, k).otherwise(out)
    return out


def _leveled(df: DataFrame, bin_size: int) -> DataFrame:
    return df.withColumn("__level", _level(F.col("__e") - F.col("__s"), bin_size))


def _in_bins(df: DataFrame, own: list[int], other: list[int], bin_size: int) -> DataFrame:
    """A row for each bin that __s to __e touches: on its own level, where it meets the other side's finer ones, and on each coarser level of the other side."""
    some = F.array(*[F.struct(F.lit(x).alias("m"), F.lit(bin_size * WIDER**x).cast("long").alias("w"), F.lit(x in other).alias("met")) for x in sorted({*own, *other})])
    met = F.filter(some, lambda x: ((x["m"] == F.col("__level")) & (x["m"] >= min(other))) | ((x["m"] > F.col("__level")) & x["met"]))
    out = df.withColumn("__x", F.explode(met)).withColumn("__m", F.col("__x.m"))
    first, last = F.floor(F.col("__s") / F.col("__x.w")), F.floor((F.col("__e") - 1) / F.col("__x.w"))
    return out.withColumn("__first", first).withColumn("__bin", F.explode(F.sequence(first, last))).drop("__x")


def _hot_bins(df: DataFrame, on: list[str], rows: int, name: str) -> DataFrame:
    """The hot bins and how many parts their rows are dealt to; at most 2 * LEVELS * HOT_SHARE of them."""
    least = max(HOT_ROWS, rows // HOT_SHARE)
    return df.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > least).select(*on, F.ceil(F.col("n") / least).cast("int").alias(name))


def _meet(left: DataFrame, right: DataFrame, on: list[str], bin_size: int, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Pairs with equal keys whose ranges __s to __e overlap; right's columns other than the keys come prefixed r_.

    Each interval lies in the bins of a level as wide as itself, and so in two at most; it meets finer and coarser
    ones on the coarser one's level.  Only levels that occur are used.  A pair is made in the first bin that both share.
    Hot bins are dealt to a grid of parts, by a hash of the rows.  ``counted`` are the rows to count, if these are dear to make.
    """
    left, right, *counted = (_leveled(df.filter("__e > __s"), bin_size) for df in (left, right, *(counted or (left, right))))
    counts = [dict(df.groupBy("__level").count().collect()) for df in counted]  # LEVELS rows at most
    own, other = (sorted(c) or [0] for c in counts)
    a, b = _in_bins(left, own, other, bin_size), _in_bins(right, other, own, bin_size)
    keys = [*on, "__m", "__bin"]
    sizes = [sum(c.values()) for c in counts]
    hot_a, hot_b = _hot_bins(_in_bins(counted[0], own, other, bin_size), keys, sizes[0], "__na"), _hot_bins(_in_bins(counted[1], other, own, bin_size), keys, sizes[1], "__nb")
    hot = hot_a.join(hot_b, keys, "full").select(*keys, *[F.coalesce(c, F.lit(1)).alias(c) for c in ("__na", "__nb")])
    if max(sizes) > HOT_ROWS and (rows := hot.collect()):
        hot = F.broadcast(left.sparkSession.createDataFrame(rows, hot.schema))
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
        a = a.withColumn("__h", F.xxhash64(*left.columns)).join(hot, keys, "left")
        b = b.withColumn("__h", F.xxhash64(*right.columns)).join(hot, keys, "left")
        of = lambda n: F.pmod(F.col("__h"), F.coalesce(F.col(n), F.lit(1))).cast("int")
        a = a.withColumn("__pa", of("__na")).withColumn("__pb", all_of("__nb")).drop("__h", "__na", "__nb")
        b = b.withColumn("__pb", of("__nb")).withColumn("__pa", all_of("__na")).drop("__h", "__na", "__nb")
        keys = [*keys, "__pa", "__pb"]
    b = b.select(*keys, *[F.col(c).alias(f"r_{c}") for c in b.columns if c not in keys])
    hit = (F.col("__s") < F.col("r___e")) & (F.col("r___s") < F.col("__e")) & (F.col("__bin") == F.greatest("__first", "r___first")) & (F.greatest("__level", "r___level") == F.col("__m"))
    pairs = a.join(b, keys).filter(hit)
    return pairs.select(*[c for c in pairs.columns if not c.startswith(("__", "r___"))])


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str] | None = None, how: str = "inner", bin_size: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals with equal contig and keys.

    The right side's columns come prefixed r_.  how is inner, or left to keep left rows
    without a partner.  Empty intervals and null keys overlap nothing; equal rows are rows of their own.
    """
    on = ["contig", *(keys or [])]
    ranged = lambda df: df.withColumn("__s", F.col("start")).withColumn("__e", F.col("end"))
    plain = tuple(ranged(df.dropna(subset=on).select(*on, "start", "end")) for df in (left, right))
    met = _meet(ranged(_gathered(left, on)), ranged(_gathered(right, on)), on, bin_size, plain).withColumn("__y", F.explode("r_rows")).withColumn("__x", F.explode("rows"))
    bound = {c: F.col(c) for c in ("start", "end", "r_start", "r_end")}
    value = lambda c, row, side: bound[side + c] if c in ("start", "end") else F.col(f"{row}.{c}")
    pairs = met.select(*on, *[value(c, "__x", "").alias(c) for c in left.columns if c not in on], *[value(c, "__y", "r_").alias(f"r_{c}") for c in right.columns if c not in on])
    if how != "left":
        return pairs
    # rows without a partner are told from the farthest end before theirs, so pairs are never stored
    ends = right.filter("end > start").select(*on, F.col("start").alias("__at"), F.col("end").alias("__v"))
    asked = left.select(*on, F.col("end").alias("__at"))
    far = largest_before(ends, asked, on, bin_size).withColumnRenamed("__at", "end")
    alone = left.join(far, [*on, "end"], "left").filter(F.coalesce((F.col("__v") <= F.col("start")) | (F.col("end") <= F.col("start")), F.lit(True)))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in pairs.schema if f.name not in left.columns]
    columns = [*left.columns, *[c for c in pairs.columns if c.startswith("r_") and c not in left.columns]]
    return pairs.select(*columns).unionByName(alone.select(*left.columns, *nothing))


def _gathered(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys and bounds that are no empty intervals with rows, the other columns of at most about TOGETHER rows."""
    at = [*on, "start", "end"]
    df = df.filter("end > start").dropna(subset=on)
    rest = [F.col(c) for c in df.columns if c not in at] or [F.lit(0).alias("__none")]
    # counted by a hash: others of the same hash are dealt to parts as well, which costs nothing but more lists
    hashed = F.xxhash64(*at)
    many = df.groupBy(hashed.alias("__k")).agg(F.count("*").alias("__n")).filter(F.col("__n") > TOGETHER)
    part = F.lit(0)
    if many.limit(1).count():
        df = df.withColumn("__k", hashed).join(many, "__k", "left")
        part = F.pmod(F.xxhash64(F.struct(*rest)), F.ceil(F.coalesce("__n", F.lit(1)) / TOGETHER)).cast("int")
    return df.select(*at, part.alias("__part"), F.struct(*rest).alias("__row")).groupBy(*at, "__part").agg(F.collect_list("__row").alias("rows")).drop("__part")


def largest_before(values: DataFrame, asked: DataFrame, on: list[str], bin_size: int = BIN) -> DataFrame:
    """The keys and places __at of ``asked``, each once, with the largest __v of the values of equal keys at places before it; without such values, not at all.

    Each place of a bin counts once, so a bin has at most bin_size rows of a side; the largest of earlier bins comes from the bins' own ones.
    """
    some = values.groupBy(*on, "__at").agg(F.max("__v").alias("__v")).withColumn("__ask", F.lit(0))
    both = some.unionByName(asked.filter(F.col("__at").isNotNull()).select(*on, "__at").distinct().withColumn("__v", F.lit(None).cast(some.schema["__v"].dataType)).withColumn("__ask", F.lit(1)))
    both = both.dropna(subset=on).withColumn("__bin", F.floor(F.col("__at") / bin_size))
    # the bins in runs of bin_size, so that no window holds all of a contig's
    each = both.groupBy(*on, "__bin").agg(F.max("__v").alias("__m")).withColumn("__run", F.floor(F.col("__bin") / bin_size))
    before = lambda keys, by: F.max("__m").over(W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1))
    runs = each.groupBy(*on, "__run").agg(F.max("__m").alias("__m")).select(*on, "__run", before(on, "__run").alias("__r"))
    each = each.withColumn("__b", before([*on, "__run"], "__bin")).join(runs, [*on, "__run"]).select(*on, "__bin", F.greatest("__b", "__r").alias("__b"))
    own = F.max("__v").over(W.partitionBy(*on, "__bin").orderBy("__at", F.desc("__ask")).rowsBetween(W.unboundedPreceding, -1))
    found = both.withColumn("__o", own).filter("__ask = 1").join(each, [*on, "__bin"]).withColumn("__v", F.greatest("__o", "__b"))
    return found.filter("__v IS NOT NULL").select(*on, "__at", "__v")


def gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Distance of two intervals: 0 if they overlap, else bases between them plus one."""
    return F.greatest(F.lit(0), F.greatest(a_start - b_end, b_start - a_end) + 1)


def near_positives(df: DataFrame, keys: list[str], window: int = WINDOW, distance: int = 700, bin_size: int = BIN) -> DataFrame:
    """All positives, and the negatives at a distance above window and below distance from one of equal keys.

    Equal negatives all stay.  A negative looks up the last end of a positive before it and the last start after it, at
    the distance; only rows that end before they start meet others as pairs.
    """
    on = ["contig", *keys]
    at = [*on, "start", "end"]
    of = lambda label, where: df.filter((F.col("label") == label) & F.expr(where)).select(*at)
    # window < distance to a positive's end before, and to a start after it < distance
    bound = lambda c: F.col(c).cast("long")
    negative = of(0, "end >= start")
    before = largest_before(of(1, "end >= start").select(*on, bound("end").alias("__at"), bound("end").alias("__v")), negative.select(*on, (bound("start") - window + 1).alias("__at")), on, bin_size)
    before = before.filter(F.col("__v") > F.col("__at") + window - 1 - distance + 1).select(*on, (F.col("__at") + window - 1).alias("start"))
    after = largest_before(of(1, "end >= start").select(*on, bound("start").alias("__at"), bound("start").alias("__v")), negative.select(*on, (bound("end") + distance - 1).alias("__at")), on, bin_size)
    after = after.filter(F.col("__v") - (F.col("__at") - distance + 1) + 1 > window).select(*on, (F.col("__at") - distance + 1).alias("end"))
    sound, turned = df.filter("label = 0 AND end >= start"), df.filter("label IN (0, 1) AND end < start")
    marked = sound.join(before.withColumn("__p", F.lit(True)), [*on, "start"], "left").join(after.withColumn("__q", F.lit(True)), [*on, "end"], "left")
    hit = F.coalesce("__p", "__q", F.lit(False))
    near = None
    if turned.limit(1).count():
        reach = lambda rows, around: rows.distinct().withColumn("__s", F.col("start") - around).withColumn("__e", F.greatest("end", F.col("start") + 1) + around)
        met = _meet(reach(of(0, "true"), distance), reach(of(1, "true"), 0), on, bin_size).filter("end < start OR r_end < r_start")
        d = gap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
        near = met.filter((d > window) & (d < distance)).select(*at).distinct()
        marked = marked.join(near.withColumn("__n", F.lit(True)), at, "left")
        hit = F.coalesce("__p", "__q", "__n", F.lit(False))
    out = df.filter("label = 1").unionByName(marked.filter(hit).select(*df.columns))
    return out if near is None else out.unionByName(df.filter("label = 0 AND end < start").join(near, at, "left_semi"))
