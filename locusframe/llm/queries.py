"""The corpus queries, each through its operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, divergence, jaccard_join, line_dedup, minhash_dedup
from ._common import table
from .url_filter import verdict_sql, with_url_verdict

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level BPE."""
    import public_tokenizers

    from .token_counts import with_token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


#: Site rules of the url query, as its contract states them.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@query("op4_url_filter", verdict_sql(URL_RULES))
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return with_url_verdict(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query(
    "op5_vector_topk",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 5""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    from .vector_topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@query(
    "op6_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keeper FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM r""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    from .warc import digests, round_trip

    return digests(round_trip(table(spark, sf_dir, "pages")))


@query("op9_source_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 150 % mix with weights 5, 2, 1 takes of every document."""
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


@query("op3_decontamination", decontamination.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 13-word window of a benchmark item."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _part(column: str, parts: int):
    """Remainder of the CRC-32 of an id's text; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts)), F.lit(-1))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled ones outside a hash fold."""
    from . import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(_part("doc_id", 5) != 0))
    scored = toxicity.with_toxicity(docs, model)
    return scored.select("doc_id", (_part("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside a hash fold."""
    from . import language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.filter(_part("doc_id", 4) != 2))
    found = language.with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_part("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


@query("op8_jaccard_join", jaccard_join.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles are 75 % alike."""
    return jaccard_join.similarity_components(table(spark, sf_dir, "documents"))


@query("op10_line_dedup", line_dedup.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many repeat earlier ones, and a digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.without_repeated_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"))


@query("op11_minhash_dedup", minhash_dedup.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingles are 80 % alike."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_source_divergence", divergence.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source of a language from its others and from the language."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers for every document."""
    import public_tokenizers

    from .token_alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
