"""Readers of labels, peaks, annotations, expression, coverage, sequences and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.labels import label_encode, name_part

#: Fixed delimiters of a window's text form.
OUTER, STANDARD, INNER, FEATURES = "!", ",", ";", "#"
_PEAKS = "contig string, start long, end long, name string, score int, strand string, signalValue double, pValue double, qValue double, peak double"


def _path() -> Column:
    return F.col("_metadata.file_path")


def scan_delimited(spark: SparkSession, path: str, header_tag: str, sep: str = "\t") -> DataFrame:
    """fields: each line cut at the separator; every line that holds the tag anywhere is dropped."""
    lines = spark.read.text(path)
    keep = ~F.contains("value", F.lit(header_tag)) if header_tag else F.lit(True)
    return lines.filter(keep).select(F.split("value", sep.replace("|", r"\|"), -1).alias("fields"))


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """tf, cell_type, contig, start, end, label of a wide label file; its header names the cell types."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    ids, cells = wide.columns[:3], wide.columns[3:]
    long = wide.withColumn("tf", name_part(_path(), 0)).unpivot([*ids, "tf"], cells, "cell_type", "label")
    return long.select("tf", "cell_type", F.col(ids[0]).alias("contig"), F.col(ids[1]).cast("long").alias("start"), F.col(ids[2]).cast("long").alias("end"), label_encode(F.col("label")).alias("label"))


def scan_label_folder(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of label files, whose headers may differ."""
    out = scan_labels(spark, paths[0])
    for p in paths[1:]:
        out = out.unionByName(scan_labels(spark, p))
    return out


def scan_labels_max(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end and the largest label over the cell types."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    ids, cells = wide.columns[:3], wide.columns[3:]
    codes = [label_encode(F.col(f"`{c}`")) for c in cells]
    return wide.select(F.col(ids[0]).alias("contig"), F.col(ids[1]).cast("long").alias("start"), F.col(ids[2]).cast("long").alias("end"), (F.greatest(*codes) if len(codes) > 1 else codes[0]).alias("label"))


def scan_peaks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """narrowPeak files; the cell type is the second dot-part of the file name."""
    df = spark.read.option("sep", "\t").schema(_PEAKS).csv(paths)
    return df.select("contig", "start", "end", name_part(_path(), 1).alias("cell_type"), "score", "signalValue", "pValue", "qValue", "peak")


def scan_wig(spark: SparkSession, path: str) -> DataFrame:
    """Four-column signal rows; what they lack is -1, lines with # are dropped."""
    df = spark.read.option("sep", "\t").option("comment", "#").schema("contig string, start long, end long, signalValue double").csv(path)
    return df.select("contig", "start", "end", F.lit(-1).alias("score"), "signalValue", *[F.lit(-1.0).alias(c) for c in ("pValue", "qValue", "peak")])


def scan_motif_hits(spark: SparkSession, paths: str | list[str], tfs: list[str] | None = None) -> DataFrame:
    """Motif hits (columns 1-3 the region, 5 peak, 6 p); the tf is the file name up to its first _."""
    df = spark.read.option("sep", "\t").schema("motif string, contig string, start long, end long, strand string, peak double, pValue double").csv(paths)
    tf = F.split_part(name_part(_path(), 0), F.lit("_"), F.lit(1))
    out = df.select(tf.alias("tf"), "contig", "start", "end", F.lit(-1).alias("score"), F.lit(-1.0).alias("signalValue"), "pValue", F.lit(-1.0).alias("qValue"), "peak")
    return out.filter(F.col("tf").isin(tfs)) if tfs else out


def scan_genes(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, transcript_id and region of the gene features of a GTF file."""
    df = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema("contig string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string").csv(path)
    pick = lambda key: F.regexp_extract("attributes", rf'{key} "([^"]+)"', 1)
    return df.filter("feature = 'gene'").select(pick("gene_id").alias("gene_id"), pick("transcript_id").alias("transcript_id"), "contig", "start", "end")


def scan_expression(spark: SparkSession, paths: str | list[str], genes: DataFrame) -> DataFrame:
    """Expression rows joined to their genes' regions; the cell type is the second dot-part of the file name."""
    schema = "gene_id string, transcripts string, length double, effective_length double, expected_count double, TPM double, FPKM double"
    rows = spark.read.option("sep", "\t").option("header", True).schema(schema).csv(paths).withColumn("cell_type", name_part(_path(), 1)).drop("transcripts")
    return join_expression(rows, genes)


def join_expression(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """Spark broadcasts the genes if they are small enough to be."""
    return rows.join(genes.select("gene_id", "contig", "start", "end"), "gene_id")


def scan_coverage(spark: SparkSession, path: str, cell_type: str | None = None) -> DataFrame:
    """Stranded coverage kept by cell type and strand; one cell type reads only its own folders."""
    df = spark.read.parquet(path)
    return df.filter(F.col("cell_type") == cell_type) if cell_type is not None else df


def scan_reads(spark: SparkSession, path: str) -> DataFrame:
    """Aligned reads with a contig and a start that is not negative."""
    return spark.read.parquet(path).filter("contig is not null and start >= 0")


def scan_regions(spark: SparkSession, path: str) -> DataFrame:
    """BED-like regions with the sequence in the fourth column."""
    return spark.read.option("sep", "\t").schema("contig string, start long, end long, sequence string").csv(path)


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig and seq of a FASTA file: one row a record, line breaks taken out."""
    if not any(path.rstrip("/").endswith(x) for x in (".fa", ".fasta")):
        raise ValueError(f"not a FASTA file: {path}")
    records = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    head = F.split_part("value", F.lit("\n"), F.lit(1))
    body = F.substr("value", F.length(head) + 2)
    return records.select(F.split_part(F.trim(head), F.lit(" "), F.lit(1)).alias("contig"), F.replace(body, F.lit("\n"), F.lit("")).alias("seq"))


def _doubles(text: Column) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<double>")).otherwise(F.transform(F.split(text, STANDARD), lambda x: x.cast("double")))


def _records(text: Column, form: str) -> Column:
    parts = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(text, INNER))
    names = [x.split() for x in form.split(", ")]
    return F.transform(parts, lambda p: F.struct(*[F.get(F.split(p, STANDARD), F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(names)]))


PEAK_FORM = "contig string, start long, end long, score int, signalValue double, pValue double, qValue double, peak double"
RNA_FORM = "contig string, start long, end long, gene_id string, length double, effective_length double, expected_count double, TPM double, FPKM double"


_HEAD = (("label", "int"), ("tf", "string"), ("cell_type", "string"), ("contig", "string"), ("start", "long"), ("end", "long"), ("sequence", "string"), ("dnase_peak_count", "int"))


def parse_windows(df: DataFrame, column: str = "value") -> DataFrame:
    """Windows of their text form: label,tf,cell,contig,start,end,sequence,peaks ! signal ! rna ! motifs.

    Other columns stay.
    """
    part = lambda i: F.coalesce(F.get(F.split(F.col(column), OUTER, -1), F.lit(i)), F.lit(""))
    head = lambda i, t: F.get(F.split(part(0), STANDARD, -1), F.lit(i)).cast(t)
    others = [c for c in df.columns if c != column]
    return df.select(*[head(i, t).alias(n) for i, (n, t) in enumerate(_HEAD)], _doubles(part(1)).alias("dnase"), _records(part(2), RNA_FORM).alias("rnaseq"), _records(part(3), PEAK_FORM).alias("motifs"), *others)


def scan_windows(spark: SparkSession, path: str) -> DataFrame:
    return parse_windows(spark.read.text(path))


def scan_featurized(spark: SparkSession, path: str) -> DataFrame:
    """Windows with features behind the last #."""
    lines = spark.read.text(path).select(F.substring_index("value", FEATURES, 1).alias("value"), _doubles(F.substring_index("value", FEATURES, -1)).alias("features"))
    return parse_windows(lines)


def scan_sequences(spark: SparkSession, path: str, sep: str = "\t", first: int | None = None) -> DataFrame:
    """tf, cell_type, id, sequence, label of a sequence file (FoldID, EventID, seq, Bound; with header).

    tf and cell type are the first two _-parts of the file name.  first keeps that many rows
    of each file in order of id.
    """
    df = spark.read.option("sep", sep).option("header", True).schema("fold string, id string, sequence string, label int").csv(path)
    part = lambda i: F.split_part(name_part(_path(), 0), F.lit("_"), F.lit(i))
    out = df.select(part(1).alias("tf"), part(2).alias("cell_type"), "id", "sequence", "label")
    if first is not None:
        from ..operators.ranking import first_n

        out = first_n(out, first, ["tf", "cell_type"], ["id"])
    return out


def scan_pwms(spark: SparkSession, path: str) -> DataFrame:
    """Motif models as rows motif_id, tf, pos, base, p; only valid ones."""
    from ..operators.sequences import valid_pwms

    return valid_pwms(spark.read.parquet(path))
