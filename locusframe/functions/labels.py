"""Column functions over labels, names and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed label codes: ambiguous, unbound, bound; and that of regions without a label.
LABELS = {"A": -1, "U": 0, "B": 1}
UNLABELED = -10
#: The chromosomes of the training data.
CHROMOSOMES = tuple(f"chr{i}" for i in range(1, 23)) + ("chrX",)


def label_encode(text: Column) -> Column:
    """A, U and B as -1, 0 and 1; anything else is an error, null stays null."""
    out = F.when(text.isNull(), F.lit(None).cast("int"))
    for letter, code in LABELS.items():
        out = out.when(text == letter, F.lit(code))
    return out.otherwise(F.raise_error(F.concat(F.lit("not a label: "), text)).cast("int"))


def plain_cell_type(name: Column) -> Column:
    """A cell type's name without - and _."""
    return F.translate(name, "-_", "")


def valid_read(contig: Column, start: Column) -> Column:
    return contig.isNotNull() & (start >= 0)


def has_signal(signal: Column) -> Column:
    """Any number of the signal above zero (false for null and empty)."""
    return F.coalesce(F.exists(signal, lambda v: v > 0), F.lit(False))


def one_hot_category(value: Column, categories: list) -> Column:
    return F.array(*[F.coalesce((value == c), F.lit(False)).cast("double") for c in categories])


def binary_signal(signal: Column) -> Column:
    """1.0 if the signal has any number at all."""
    return F.when(F.coalesce(F.size(signal), F.lit(0)) > 0, 1.0).otherwise(0.0)


def submission_chromosome(contig: Column) -> Column:
    """Number of a chromosome: chrX is 24, chrY 25."""
    plain = F.regexp_replace(contig, "^chr", "")
    return F.when(plain == "X", 24).when(plain == "Y", 25).otherwise(plain.try_cast("int"))


def name_part(path: Column, part: int) -> Column:
    """A dot-separated part of the file name in a path; Spark's part files count to their folder."""
    last, folder = F.substring_index(path, "/", -1), F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    file = F.when(last.startswith("part-") & (folder != ""), folder).otherwise(last)  # a pattern would be tried at every letter of the path, for each row
    return F.get(F.split(file, r"\."), F.lit(part))


def submission_name(path: Column) -> Column:
    """struct(board, tf, cell_type) of a name like L.TF.CELL.tab.gz; null if it is not of that form."""
    form = r"([LFB])\.([^./]+)\.([^./]+)\.tab(?:\.gz)?(?:/part-[^/]*)?$"
    part = lambda i: F.nullif(F.regexp_extract(path, form, i), F.lit(""))
    return F.when(path.rlike(form), F.struct(part(1).alias("board"), part(2).alias("tf"), part(3).alias("cell_type")))


#: Values that an indexer may have; more are no categories.
CATEGORIES = 10_000


def fit_categories(df: DataFrame, column: str) -> list[str]:
    """The values of a column of the fitting table, most frequent first, ties by the value; nulls are none."""
    rows = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(CATEGORIES + 1).collect()
    if len(rows) > CATEGORIES:
        raise ValueError(f"{column} has more than {CATEGORIES} values")
    return [r["v"] for r in rows]


def category_features(column: Column, categories: list[str]) -> Column:
    """Indicators of a value of any table under fitted categories; zeros for null and for values that the fit did not see."""
    return one_hot_category(column.cast("string"), categories) if categories else F.array().cast("array<double>")
