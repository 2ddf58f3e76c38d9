"""The given tables seen as reads, peaks, windows, sequences, scores and submissions.

Each view exists twice, as a DataFrame and as a DuckDB common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed grid of the views: contigs are event types of 43,200 minutes (30 days).
CONTIG_LENGTH, CHUNK = 43_200, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minute():
    return F.timestamp_diff("MINUTE", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col("ts"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    start = _minute()
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("contig"), start.alias("start"), (start + 1 + F.col("event_id") % 60).alias("end"),
        F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"), F.concat(F.lit("f"), (F.col("user_id") % 4).cast("string")).alias("file"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("cell_type"),
    )


def peaks(spark: SparkSession, d: str) -> DataFrame:
    start = _minute()
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("contig"), start.alias("start"), (start + 1 + F.floor("value")).alias("end"),
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("cell_type"), F.col("value").alias("signal"),
    )


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("contig")).distinct().withColumn("length", F.lit(CONTIG_LENGTH).cast("long"))


def windows(spark: SparkSession, d: str) -> DataFrame:
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(43_000).cast("long"), F.lit(50).cast("long")))
    return lengths(spark, d).select("contig", start.alias("start")).withColumn("end", F.col("start") + 200)


def _folded(spark: SparkSession, d: str, text) -> DataFrame:
    folded = F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", "ATCGATCGATCGATCGATCGATCGAT")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace(folded, "[^ATCG]", "N").alias("sequence"))


def whole_sequences(spark: SparkSession, d: str) -> DataFrame:
    """id and sequence: folded letters of whole documents."""
    return _folded(spark, d, F.col("text"))


def windowed(df: DataFrame, letters: int = 200) -> DataFrame:
    """Folded sequences, with the other columns, in consecutive windows, the last one as long as what is left."""
    # folded letters have no line breaks; the pattern goes through a text once, while each substring is counted out from the front
    return df.select(*[c for c in df.columns if c != "sequence"], F.posexplode(F.regexp_extract_all("sequence", F.lit(f".{{1,{letters}}}"), F.lit(0))).alias("window", "sequence"))


def sequence_windows(spark: SparkSession, d: str, letters: int = 200) -> DataFrame:
    """id, window and sequence: whole documents in consecutive windows, the last of a document as long as what is left."""
    return windowed(whole_sequences(spark, d), letters)


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """id and sequence: every window of 200 letters of every document; the id is that of the document times a million, plus the window's place."""
    return sequence_windows(spark, d).select((F.col("id") * 1_000_000 + F.col("window")).alias("id"), "sequence")


def document_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of 200 letters of each labelled document, to its end, with its quality and toxicity as labels."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n")).filter("n > 0")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(200).cast("long")))
    labelled = table(spark, d, "labels").join(docs, "doc_id")
    return labelled.select(F.col("doc_id").cast("string").alias("contig"), start.alias("start"), "quality", "toxic").withColumn("end", F.col("start") + 200)


def document_reads(spark: SparkSession, d: str) -> DataFrame:
    """Events as reads and peaks of documents: ten events to a document, by event id, on its first 4,000 letters."""
    contig, start = F.floor(F.col("event_id") / 10).cast("string"), (_minute() % 4000).cast("long")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), contig.alias("contig"), start.alias("start"), (start + 1 + F.col("event_id") % 60).alias("end"), (start + 1 + F.floor("value")).alias("peak_end"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("cell_type"),
        F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    score = F.round(F.col("n_chars") / (F.col("n_chars") + 1000.0), 6)
    return table(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.col("toxic"), score.alias("score"))


def features(spark: SparkSession, d: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("label"), x.alias("features"), F.concat(F.lit("chr"), (F.col("vec_id") % 5 + 1).cast("string")).alias("contig"), F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")).alias("cell_type"))


def submissions(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tf"), F.col("o_orderstatus").alias("sample"), (F.col("o_custkey") % 8).alias("user"), F.col("o_orderdate").alias("date"), (F.col("o_orderkey") % 3).alias("bootstrap"),
        *[(cents % m).alias(f"m{i}") for i, m in enumerate((97, 89, 83, 79))],
    )


def one_per_board(spark: SparkSession, d: str) -> DataFrame:
    """The submission with the largest id of each user, tf, sample and bootstrap."""
    keys = ["user", "tf", "sample", "bootstrap"]
    s = submissions(spark, d)
    return s.groupBy(*keys).agg(F.max_by(F.struct("m0", "m1", "m2", "m3"), "id").alias("m")).select(*keys, "m.*")


def genes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("gene_id"), F.lit("t").alias("transcript_id"), F.col("p_brand").alias("contig"), (F.col("p_partkey") * 100).alias("start"), (F.col("p_partkey") * 100 + F.col("p_size")).alias("end"))


def expression(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("gene_id"), F.lit("t").alias("transcripts"), F.col("l_quantity").alias("length"), F.col("l_tax").alias("effective_length"), F.col("l_extendedprice").alias("expected_count"), F.col("l_discount").alias("TPM"), F.col("l_quantity").alias("FPKM"),
    )


def reference(spark: SparkSession, d: str) -> DataFrame:
    """contig and seq: folded letters of whole documents."""
    return whole_sequences(spark, d).select(F.col("id").cast("string").alias("contig"), F.col("sequence").alias("seq"))


def wide_labels(spark: SparkSession, d: str) -> DataFrame:
    """A wide label table of two cell types."""
    code = lambda c: F.when(F.col(c) == 1, "B").when(F.col("doc_id") % 7 == 0, "A").otherwise("U")
    return table(spark, d, "labels").select(F.concat(F.lit("chr"), (F.col("doc_id") % 3 + 1).cast("string")).alias("chr"), (F.col("doc_id") * 50).alias("start"), (F.col("doc_id") * 50 + 200).alias("stop"), code("quality").alias("HepG2"), code("toxic").alias("MCF-7"))


_MINUTE = "date_diff('minute', TIMESTAMP '2024-01-01 00:00:00', ts)"
CTE = {
    "reads": f"""reads AS (SELECT event_id AS id, event_type AS contig, {_MINUTE} AS s, {_MINUTE} + 1 + event_id % 60 AS e,
  CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand, 'f' || (user_id % 4) AS file, 'c' || (user_id % 3) AS cell_type FROM events)""",
    "cuts": """cuts AS (SELECT id, contig, strand, file, cell_type, unnest([s, e]) - CASE WHEN strand = '-' THEN 1 ELSE 0 END AS s FROM reads WHERE s >= 0)""",
    "peaks": f"""peaks AS (SELECT event_id AS id, event_type AS contig, {_MINUTE} AS s, {_MINUTE} + 1 + floor(value)::BIGINT AS e, 'c' || (user_id % 3) AS cell_type, value AS signal FROM events)""",
    "windows": "windows AS (SELECT contig, s, s + 200 AS e FROM (SELECT DISTINCT event_type AS contig FROM events), (SELECT unnest(range(0, 43001, 50)) AS s))",
    "sequences": """folded AS (SELECT doc_id AS id, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ATCGATCGATCGATCGATCGATCGAT'), '[^ATCG]', 'N', 'g') AS seq FROM documents),
sequences AS (SELECT id * 1000000 + i // 200 AS id, substr(seq, i + 1, 200) AS seq FROM (SELECT id, seq, unnest(range(0, length(seq), 200)) AS i FROM folded))""",
    "whole_sequences": """sequences AS (SELECT doc_id AS id, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ATCGATCGATCGATCGATCGATCGAT'), '[^ATCG]', 'N', 'g') AS seq FROM documents)""",
    "reference": """reference AS (SELECT doc_id::VARCHAR AS contig, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ATCGATCGATCGATCGATCGATCGAT'), '[^ATCG]', 'N', 'g') AS seq FROM documents)""",
    "document_regions": "regions AS (SELECT doc_id::VARCHAR AS contig, s, s + 200 AS e, quality, toxic FROM (SELECT doc_id, quality, toxic, unnest(range(0, length(text), 200)) AS s FROM labels JOIN documents USING (doc_id)))",
    "document_reads": f"""dreads AS (SELECT event_id AS id, (event_id // 10)::VARCHAR AS contig, {_MINUTE} % 4000 AS s, {_MINUTE} % 4000 + 1 + event_id % 60 AS e, {_MINUTE} % 4000 + 1 + floor(value)::BIGINT AS pe, 'c' || (user_id % 3) AS cell_type, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM events)""",
    "scored": "scored AS (SELECT doc_id AS id, quality AS label, toxic, round(n_chars / (n_chars + 1000.0::DOUBLE), 6) AS score FROM labels JOIN documents USING (doc_id))",
    "features": "features AS (SELECT vec_id AS id, (label = 0)::INT AS label, list_transform(embedding, lambda v: v::DOUBLE) AS features, 'chr' || (vec_id % 5 + 1) AS contig, 'c' || (vec_id % 3) AS cell_type FROM embeddings)",
    "submissions": """submissions AS (SELECT o_orderkey AS id, o_orderpriority AS tf, o_orderstatus AS sample, o_custkey % 8 AS "user", o_orderdate AS date, o_orderkey % 3 AS bootstrap,
  round(o_totalprice * 100)::BIGINT % 97 AS m0, round(o_totalprice * 100)::BIGINT % 89 AS m1, round(o_totalprice * 100)::BIGINT % 83 AS m2, round(o_totalprice * 100)::BIGINT % 79 AS m3 FROM orders)""",
    "genes": "genes AS (SELECT p_partkey::VARCHAR AS gene_id, 't' AS transcript_id, p_brand AS contig, p_partkey * 100 AS s, p_partkey * 100 + p_size AS e FROM part)",
    "expression": "expression AS (SELECT l_partkey::VARCHAR AS gene_id, l_quantity AS length, l_tax AS effective_length, l_extendedprice AS expected_count, l_discount AS TPM, l_quantity AS FPKM FROM lineitem)",
    "wide": """wide AS (SELECT 'chr' || (doc_id % 3 + 1) AS contig, doc_id * 50 AS s, doc_id * 50 + 200 AS e,
  CASE WHEN quality = 1 THEN 1 WHEN doc_id % 7 = 0 THEN -1 ELSE 0 END AS q, CASE WHEN toxic = 1 THEN 1 WHEN doc_id % 7 = 0 THEN -1 ELSE 0 END AS t FROM labels)""",
}


def sql(body: str, *views: str) -> str:
    """A query over the named views; a body that starts with a comma has views of its own first."""
    return ("WITH " + ",\n".join(CTE[v] for v in views) + "\n" if views else "") + body
