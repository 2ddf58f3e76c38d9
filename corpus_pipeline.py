"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from locusframe.llm import decontamination, jaccard_join, line_dedup, mixing, toxicity
from locusframe.llm._common import stored, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance does not call toxic.

    Fitted on the rows that labels marks.  Rows of null and empty texts stay; equal texts are judged alike, rows of
    one id each by its own text; null ids are judged but teach nothing.  All columns stay as they are, also
    those that are called like the operator's own.  Empty tables give empty results; without labels all stays.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    others = [c for c in docs.columns if c != "text"]
    judged = toxicity.with_toxicity(docs.select(F.struct(*others).alias("row"), "text"), model)
    return judged.filter("predicted = 0").select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which nothing but white space is left go.

    The first place of a line, by id and line number, keeps it; null ids come last, and rows equal in id keep equal
    lines.  Null and empty texts stay as they are.  n_chars, if there is such a column, follows changed texts;
    all other columns stay, also those called n_lines and n_dropped.  An empty table gives an empty result.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = line_dedup.without_repeated_lines(docs.select("doc_id", "text", F.struct(F.lit(0), *others).alias("row")))
    some = (F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")

    def column(c: str):
        if c in ("doc_id", "text"):
            return F.col(c)
        own = F.col(f"row.`{c}`")
        return F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(own).alias(c) if c == "n_chars" else own

    return kept.filter(some).select(*[column(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id.

    Null ids come last.  Rows are told apart by a hash of id and text: of rows equal in both one is kept, rows of one
    id and different texts are judged each by its own.  Texts without words (null, empty, white space) are in no
    group and all stay.  All columns are kept as they are; an empty table gives an empty result.
    """
    key, place, one = unused(docs, "__key", "__place", "__one")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    groups = stored(jaccard_join.similarity_components(keyed, id_col=key).select(F.col("doc_id").alias(key), "n_shingles", "component_id").distinct())
    named = groups.filter("n_shingles > 0").join(keyed.select(key, "doc_id").distinct(), key)
    least = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("m")).select(F.col(f"m.{key}").alias(key), F.lit(True).alias(one))
    kept = least.unionByName(groups.filter("n_shingles = 0").select(key, F.lit(False).alias(one)))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    ranked = keyed.join(kept, key).withColumn(place, F.row_number().over(W.partitionBy(key).orderBy(key, *others)))
    return ranked.filter((F.col(place) == 1) | ~F.col(one)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text does not hold too much of the benchmark.

    Each row is judged by its own text, whatever its id; null and empty texts have no words and stay.  Repeated rows
    are judged alike.  All columns are kept as they are; an empty table on either side drops nothing.
    """
    (key,) = unused(docs, "__key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = decontamination.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    return keyed.join(found.filter("contaminated").select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document left, as mix_sources returns them.

    Null sources are one source, null ids and repeated rows are documents of their own, null and empty texts have
    size 0; other columns are not read.  An empty table gives an empty result.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mix", mix),
]
#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
