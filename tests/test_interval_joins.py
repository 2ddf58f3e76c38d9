"""Overlap and distance joins on intervals of very different lengths and in hot bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import intervals as I

FORM = "id long, contig string, start long, end long"


def some(rng, n, contig="c"):
    """Short, long and chromosome-long intervals, empty ones, and many in one bin."""
    length = np.concatenate([rng.integers(1, 400, n), rng.integers(1000, 90_000, n // 4), rng.integers(10**6, 2 * 10**8, n // 10), np.zeros(5, int)])
    start = np.concatenate([rng.integers(0, 300_000, n // 2), rng.integers(5000, 5900, n - n // 2), rng.integers(0, 2 * 10**6, n // 4), rng.integers(0, 10**6, n // 10), np.full(5, 5500)])
    rows = [(i, contig, int(s), int(s + x)) for i, (s, x) in enumerate(zip(start, length, strict=True))]
    return [*rows, rows[0], (None, None, 3, 9)]


def plain(a, b):
    return sorted(((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3]), key=repr)


@pytest.mark.parametrize("hot", [1 << 30, 20])
def test_overlaps_of_all_lengths(spark, monkeypatch, hot):
    monkeypatch.setattr(I, "HOT_ROWS", hot)
    monkeypatch.setattr(I, "HOT_SHARE", 10**9)
    rng = np.random.default_rng(hot % 97)
    a, b = some(rng, 150), some(rng, 130)
    left, right = spark.createDataFrame(a, FORM), spark.createDataFrame(b, FORM)
    want = plain(a, b)
    got = I.overlap_join(left, right)
    assert got.columns == ["contig", "id", "start", "end", "r_id", "r_start", "r_end"]
    assert sorted(((r.id, r.r_id) for r in got.collect()), key=repr) == want
    alone = [(x[0], None) for x in a if x[0] not in {i for i, _ in want}]
    assert sorted(((r.id, r.r_id) for r in I.overlap_join(left, right, how="left").collect()), key=repr) == sorted(want + alone, key=repr)


def test_rows_made_are_few(spark):
    """A chromosome-long interval lies in two bins at most on each level that occurs, not in every bin of the narrowest."""
    rows = spark.createDataFrame([(0, "c", 0, 200_000_000), (1, "c", 5, 9), (2, "c", 990, 2010), (3, "c", 70_000, 140_000)], FORM)
    ranged = I._leveled(rows.withColumn("__s", F.col("start")).withColumn("__e", F.col("end")), I.BIN)
    levels = sorted(r[0] for r in ranged.select("__level").distinct().collect())
    made = {r.id: r.n for r in I._in_bins(ranged, levels, levels, I.BIN).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert made[0] <= 2 and max(made.values()) <= 2 * len(levels)


def test_a_hot_bin_is_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(I, "HOT_ROWS", 50)
    monkeypatch.setattr(I, "HOT_SHARE", 10**9)
    rows = spark.range(400).select("id", F.lit("c").alias("contig"), (F.col("id") % 300).alias("start"), (F.col("id") % 300 + 5).alias("end"))
    few = spark.range(40).select("id", F.lit("c").alias("contig"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 3).alias("end"))
    joined = I.overlap_join(rows, few)
    assert "__pa" in joined._jdf.queryExecution().optimizedPlan().toString()
    a, b = [tuple(r) for r in rows.collect()], [tuple(r) for r in few.collect()]
    assert sorted(((r.id, r.r_id) for r in joined.collect()), key=repr) == plain(a, b)


@pytest.mark.parametrize("hot", [1 << 30, 15])
def test_near_positives_equal_the_plain_condition(spark, monkeypatch, hot):
    monkeypatch.setattr(I, "HOT_ROWS", hot)
    monkeypatch.setattr(I, "HOT_SHARE", 10**9)
    rng = np.random.default_rng(3)
    rows = [(*r[:4], int(rng.integers(0, 3)) - 1) for r in some(rng, 120) if r[1]]
    rows = [(i, c, s + int(rng.integers(0, 4)) * 1500, e + 9000, y) if i % 11 == 0 else (i, c, s, e, y) for i, c, s, e, y in rows]
    gap = lambda x, y: max(0, max(x[2] - y[3], y[2] - x[3]) + 1)
    want = sorted([(r[0], 1) for r in rows if r[4] == 1] + [(x[0], 0) for x in rows if x[4] == 0 and any(y[4] == 1 and 200 < gap(x, y) < 700 for y in rows)])
    got = I.near_positives(spark.createDataFrame(rows, FORM + ", label int"), [])
    assert sorted((r.id, r.label) for r in got.collect()) == want


def test_left_join_stores_no_pairs(spark):
    """Rows without a partner are added to the pairs; nothing is joined or shuffled after the pairs are made."""
    rows = spark.createDataFrame([(0, "c", 0, 20), (1, "c", 30, 40), (2, "d", 0, 9), (3, "c", 7, 7), (4, None, 0, 9)], FORM)
    other = spark.createDataFrame([(9, "c", 19, 30)], FORM)
    out = I.overlap_join(rows, other, how="left")
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
    assert sorted(((r.id, r.r_id) for r in out.collect())) == [(0, 9), (1, None), (2, None), (3, None), (4, None)]


@pytest.mark.parametrize("together", [4096, 3])
def test_equal_bounds_meet_as_one(spark, monkeypatch, together):
    """Copies do not multiply what the join compares, and all of their pairs are given."""
    monkeypatch.setattr(I, "TOGETHER", together)
    met, real = [], I._meet
    monkeypatch.setattr(I, "_meet", lambda *a: met.append(real(*a)) or met[0])
    rows = spark.range(50).select("id", F.lit("c").alias("contig"), F.lit(10).cast("long").alias("start"), (F.lit(20) + F.col("id") % 2).alias("end"))
    pairs = I.overlap_join(rows, rows).select("id", "r_id").collect()
    assert sorted(map(tuple, pairs)) == [(i, j) for i in range(50) for j in range(50)]
    assert met[0].count() == 4 if together == 4096 else 4 < met[0].count() < 2500


def test_largest_before_across_bins_and_runs(spark):
    rng = np.random.default_rng(3)
    values = [("c" if i % 2 else "d", int(a), int(v)) for i, (a, v) in enumerate(rng.integers(-300, 900, (60, 2)))]
    places = [(k, int(a)) for k in ("c", "d", "e") for a in rng.integers(-350, 950, 80)]
    got = I.largest_before(spark.createDataFrame(values, "k string, __at long, __v long"), spark.createDataFrame(places, "k string, __at long"), ["k"], 5).collect()
    want = {(k, a): max(v) for k, a in places if (v := [y for x, b, y in values if x == k and b < a])}
    assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want)


def test_near_positives_meet_no_pairs(spark, monkeypatch):
    """Hundreds of positives near a negative are one lookup."""
    monkeypatch.setattr(I, "_meet", lambda *a: pytest.fail("pairs are made"))
    df = spark.createDataFrame([(0, "c", "x", 1000, 1100, 0), (1, "c", "x", 100, 301, 1), (2, "c", "y", 100, 300, 0), (3, "d", "x", 0, 9, 0), (4, "c", "x", 500, 500, 0), (5, "c", "x", 500, 502, 0)], "id long, contig string, cell_type string, start long, end long, label int")
    assert sorted(r.id for r in I.near_positives(df, ["cell_type"]).collect()) == [1]
    assert sorted(r.id for r in I.near_positives(df, ["cell_type"], window=199).collect()) == [1, 4, 5]


def test_overlap_join_shuffles_its_rows_once(spark):
    """Rows are gathered for the join itself; levels and hot bins are counted without that."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    n = 60_000
    start = F.pmod(F.xxhash64("id"), F.lit(50_000))
    rows = spark.range(0, n, 1, 4).select("id", F.lit("chr1").alias("contig"), start.alias("start"), (start + 1 + F.col("id") % 5).alias("end"))
    before = written()
    pairs = I.overlap_join(rows, rows)
    assert written() - before < 20 * 2 * n  # a count of each side's bounds
    assert pairs.filter("id = r_id").count() == n
