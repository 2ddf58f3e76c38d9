"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

#: Arrow batches handed to Python hold at most so many rows and bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Limit the Arrow batches by bytes too, so that long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share, for tables between two jobs."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set, and the executors share no other folder")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/locusframe-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many more underscores in front as it takes for no column to be called so."""
    own = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in own:
            n = f"_{n}"
        out.append(n)
    return out


def add_columns(
    df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]]
) -> DataFrame:
    """Append columns computed from one column, batch by batch.

    ``make`` runs once a task and returns the function from an Arrow array to one
    array per field.  A column of the same name as a new one is replaced, whatever the case of its letters.
    """
    bounded_batches(df.sparkSession)
    names = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in names or c.lower() == column.lower()]
    hidden = column.lower() in names
    source = df.select(*[df[c] for c in keep])
    schema = T.StructType([f for f in source.schema.fields if f.name.lower() not in names] + fields)
    at = [c.lower() for c in keep].index(column.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for b in batches:
            kept = [c for i, c in enumerate(b.columns) if not (hidden and i == at)]
            new = [x.cast(_arrow(f.dataType)) for x, f in zip(compute(b.column(at)), fields, strict=True)]
            yield pa.RecordBatch.from_arrays(kept + new, names=schema.names)

    return source.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
