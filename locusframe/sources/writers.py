"""Writers of windows, features, scores, predictions, cuts, coverage and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .readers import FEATURES, INNER, OUTER, PEAK_FORM, RNA_FORM, STANDARD

#: Rows of one output file.
FILE_ROWS = 1_000_000


def record_csv(fields: list[Column]) -> Column:
    """Fields as one text with commas."""
    return F.array_join(F.array(*[f.cast("string") for f in fields]), STANDARD, "")


def record_fields(text: Column, form: str) -> Column:
    """struct of a record's text, by a form like ``a string, b long``."""
    names = [x.split() for x in form.split(", ")]
    return F.struct(*[F.get(F.split(text, STANDARD), F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(names)])


def _list(column: str, form: str) -> Column:
    names = [x.split()[0] for x in form.split(", ")]
    return F.array_join(F.transform(F.coalesce(F.col(column), F.array()), lambda r: record_csv([r[n] for n in names])), INNER)


def window_text(df: DataFrame) -> Column:
    """A window's text form; columns rnaseq and motifs may be missing."""
    head = record_csv([F.col(c) for c in ("label", "tf", "cell_type", "contig", "start", "end", "sequence", "dnase_peak_count")])
    signal = F.array_join(F.transform(F.coalesce("dnase", F.array().cast("array<double>")), lambda v: v.cast("string")), STANDARD)
    rest = [_list(c, f) if c in df.columns else F.lit("") for c, f in (("rnaseq", RNA_FORM), ("motifs", PEAK_FORM))]
    return F.concat_ws(OUTER, head, signal, *rest)


def write_windows(df: DataFrame, path: str, text: bool = False) -> None:
    """Parquet by tf, or one line a window."""
    if text:
        df.select(window_text(df).alias("value")).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("tf").parquet(path)


def write_featurized(df: DataFrame, path: str) -> None:
    numbers = F.array_join(F.transform("features", lambda v: v.cast("string")), STANDARD)
    df.select(F.concat_ws(FEATURES, window_text(df), numbers).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = False, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", sep).option("header", header).option("maxRecordsPerFile", FILE_ROWS).csv(path)


def write_scores(df: DataFrame, path: str) -> None:
    write_table(df.select("contig", "start", "end", "score"), path)


def write_predictions(df: DataFrame, path: str) -> None:
    write_table(df.select("label", "score"), path, sep=",")


def write_prediction_features(df: DataFrame, path: str) -> None:
    """Regions as features: the label as phase, the score as score."""
    df.select("contig", "start", "end", F.col("label").alias("phase"), "score").write.mode("overwrite").parquet(path)


def write_board(df: DataFrame, path: str, contigs: tuple[str, ...] | None = None) -> None:
    """Scores scaled to 0..1 in board order; rows stay sorted across the output files."""
    from ..operators.metrics import minmax_scale
    from ..operators.ranking import board_order

    scaled = minmax_scale(df, "score").select("contig", "start", "end", F.round("scaled", 6).alias("score"))
    write_table(board_order(scaled, contigs is not None, contigs or ()), path)


def write_cuts(df: DataFrame, path: str) -> None:
    """Cuts by cell type; an output that exists is left alone."""
    df.write.mode("ignore").partitionBy("cell_type").parquet(path)


def write_coverage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell_type", "strand").parquet(path)


def write_region_sequences(regions: DataFrame, chunks: DataFrame, path: str) -> None:
    from ..operators.sequences import extract_sequences

    extract_sequences(regions, chunks).write.mode("overwrite").parquet(path)
