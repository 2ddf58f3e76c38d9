"""Benchmark decontamination by winnowing, in DataFrame operations only.

Texts are compared by spans of consecutive words.  A fingerprint is the least hash of
short word groups within a sliding window; two texts that share a whole span share its
fingerprint, so joining fingerprints misses none.  Hits are then extended: the spans
around each shared fingerprint are compared word by word with those of the items.
All texts are read once; only documents that share a fingerprint are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._common import stored
from .url_filter import LOWER, UPPER

#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Stands in the list of fingerprints for the document itself.
_ITSELF = -1


def _low(text: Column) -> Column:
    """A-Z lowered; the built-in lower() does it for pure ASCII, and fast."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.coalesce(F.transform(words, _low), F.array().cast("array<string>"))


def _once(value: Column) -> Column:
    """Compute an array once a row: a generator keeps the optimizer from copying it into each use."""
    return F.explode(F.array(value))


def _up_to(n: Column) -> Column:
    """1 to n, or nothing if n is less than 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: str, k: int) -> Column:
    """Hash of every group of k consecutive words, by position; the length is part of it."""
    at = lambda i: [F.get(F.col(hashes), i + (j - 1)) for j in range(k)]
    return F.transform(_up_to(F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.lit(k), *at(i)))


def _with_hashes(df: DataFrame) -> DataFrame:
    """Add h, the hash of every word of w."""
    return df.select(*df.columns, _once(F.transform("w", lambda v: F.xxhash64(v))).alias("h"))


def _with_fingerprints(df: DataFrame, span: int, group: int, short: list[int], more: list[Column]) -> DataFrame:
    """One row for each distinct fingerprint f of w (words), and for more; for short lengths every word group is one."""
    width = span - group + 1
    keys = [c for c in df.columns if c != "w"]
    df = _with_hashes(df).select(*keys, "h", _once(_grams("h", group)).alias("g"))
    least = F.transform(_up_to(F.size("g") - (width - 1)), lambda i: F.array_min(F.slice(F.col("g"), i, width)))
    parts = [*more, least, *[_grams("h", n) for n in short]]
    return df.select(*keys, F.explode(F.array_distinct(F.concat(*parts))).alias("f"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, span: int = 13, group: int = 5, share: int = 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document.

    A window is ``span`` consecutive words of an item, or all words of a shorter one.  A
    word of a document is hit if it lies in an occurrence of a window.  A document is
    contaminated if it has hits and share * n_hit >= n_words.  items_sha256 is of the ids of
    the items with occurring windows, sorted as strings, with commas.  Null and empty
    texts have no words; a null item id counts as an empty string; items of one id count
    once.  Repeated rows get equal results, null ids are kept; other columns are not read.
    Empty tables are fine on either side.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    base = base.select("doc_id", F.xxhash64("t").alias("x"), "t")
    items = (
        benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), _once(words_of(F.col(item_text_col))).alias("w"))
        .withColumn("n", F.least(F.size("w"), F.lit(span)))
        .filter("n > 0")
    )
    short = sorted(r[0] for r in items.filter(F.col("n") < span).select("n").distinct().collect())  # under span values
    windows = (
        items.select("item", "n", "w", F.explode(_up_to(F.size("w") - F.col("n") + 1)).alias("at"))
        .select("item", "n", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("window"))
        .groupBy("n", "window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    itself = F.array(F.lit(_ITSELF).cast("long"))
    # tables whose size is known are broadcast by the planner where they are small, and joined by a shuffle where not
    one = docs.sparkSession.range(1).select(F.lit(_ITSELF).cast("long").alias("f"))
    item_prints = stored(_with_fingerprints(items.select("w"), span, group, short, []).unionByName(one).distinct())
    # the one pass over all texts: a row for each document, and one for each fingerprint that an item has too
    read = base.select("doc_id", "x", _once(words_of(F.col("t"))).alias("w")).select("doc_id", "x", F.size("w").cast("long").alias("n_words"), "w")
    marks = stored(_with_fingerprints(read, span, group, short, [itself]).join(item_prints, "f"))
    seeds = stored(marks.filter(F.col("f") != _ITSELF).groupBy(F.col("doc_id").alias("sid"), F.col("x").alias("sx")).agg(F.collect_set("f").alias("seeds")))

    near = base.join(seeds, F.expr("doc_id <=> sid and x = sx")).select("doc_id", "x", "seeds", _once(words_of(F.col("t"))).alias("w"))
    near = _with_hashes(near).select("*", _once(_grams("h", group)).alias("g"))
    total = F.size("w")

    def starts(grams: Column, before: int, n: int) -> Column:
        """Starts of the spans of n words that hold a seed, from up to ``before`` words ahead of it."""
        hit = F.array_compact(F.transform(grams, lambda h, i: F.when(F.array_contains("seeds", h), i + 1)))
        around = F.flatten(F.transform(hit, lambda p: F.sequence(F.greatest(p - before, F.lit(1)), p)))
        return F.transform(F.filter(F.array_distinct(around), lambda s: s <= total - (n - 1)), lambda s: F.struct(s.alias("at"), F.lit(n).alias("n")))

    spans = starts(F.col("g"), span - group, span)
    if short:
        spans = F.concat(spans, *[starts(_grams("h", n), 0, n) for n in short])
    spans = near.select("doc_id", "x", "w", F.explode(spans).alias("s")).select("doc_id", "x", F.col("s.at").alias("at"), F.col("s.n").alias("n"), F.array_join(F.slice("w", F.col("s.at"), F.col("s.n")), " ").alias("window"))
    hits = (
        spans.join(windows, ["n", "window"])
        .groupBy("doc_id", "x")
        .agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        .select(
            F.col("doc_id").alias("hit_id"),
            F.col("x").alias("hit_x"),
            F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))).cast("long").alias("n_hit"),
            F.sort_array("items").alias("items"),
        )
    )
    counted = marks.filter(F.col("f") == _ITSELF).select("doc_id", "x", "n_words")
    out = counted.join(hits, F.expr("doc_id <=> hit_id and x = hit_x"), "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    found = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM
  (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 13) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
