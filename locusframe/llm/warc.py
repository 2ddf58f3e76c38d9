"""WARC archives: writing captures, reading them back, and assembling transactions.

A capture is three records, request, response (or revisit) and metadata; the first and
last name the second in WARC-Concurrent-To.  Reading joins them again by that name.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ._common import bounded_batches, shared_dir, stored

#: Payloads from this size on are stored once; further captures of them are revisits.
REVISIT_BYTES = 1000
#: An archive file holds captures of about so many bytes before compression, or one larger capture.
FILE_BYTES = 64 << 20
#: Payloads are written by classes of size, in powers of this, so that a number of records bounds a file's bytes.
SIZE_STEP = 16
#: Fixed values of the format.
EOL, END, VERSION = "\r\n", "\r\n\r\n", "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str | Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record, without the two line ends behind it; fields that are null are left out."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind))]
    lines += [F.concat(F.lit(f"{n}: "), v) for n, v in [*fields, ("Content-Length", F.octet_length(block).cast("string"))]]
    return F.concat(F.concat_ws(EOL, *lines), F.lit(END), block)


def write_captures(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write page_id, url, html as gzip-compressed archives below path.

    Of captures with equal payloads of REVISIT_BYTES or more, that with the largest page_id
    is a response and the others are revisits of it; all smaller ones are responses.  Rows
    that share the largest page_id are all responses.  A null html is an empty payload, a
    null page_id or url is left out of the headers; a null page_id never is the largest.
    Line ends within a url are escaped.  Other columns are not read.  Record ids come from the rows, equal rows are
    numbered, so writing again what a lost task wrote gives the same records.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
        html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes"),
    )
    own = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest", F.col("url"))  # a null url leaves no space
    base = base.withColumn("key", F.md5(own.cast("binary")))
    # what the rows are told apart by, without the payloads
    light = stored(base.select("key", "page_id", "digest", "bytes"))
    first = (
        light.filter(F.col("bytes") >= REVISIT_BYTES)
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("keeper"), F.max_by("key", F.struct("page_id", "key")).alias("keeper_key"), F.count("*").alias("n"))
        .filter("n > 1 and keeper is not null")
        .select("digest", "bytes", "keeper", "keeper_key")
    )
    # stored tables of known size: joined without moving the payloads where they are small; smaller payloads never meet the first
    repeated = stored(light.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1"))
    again = base.join(repeated, "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "html", "digest", "bytes")], F.first("copies").alias("copies"))
    again = again.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    base = base.join(repeated, "key", "left_anti").withColumn("copy", F.lit(1).cast("long")).unionByName(again)
    big = F.col("bytes") >= REVISIT_BYTES
    small = base.filter(~big).withColumns({"keeper": F.lit(None).cast("long"), "keeper_key": F.lit(None).cast("string")})
    rows = base.filter(big).join(stored(first), ["digest", "bytes"], "left").unionByName(small)
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    rows = rows.select(
        "*",
        F.concat_ws(" ", "key", "copy").alias("seq"),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"),
        F.when(revisit, F.col("keeper")).alias("refers"),
    )

    def name(part: str, seq: Column | None = None) -> Column:
        digest = F.md5(F.concat(F.lit(f"{path}/{part}/"), F.col("seq") if seq is None else seq).cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))

    shared = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))]
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
        F.when(F.col("kind") == "response", F.col("html")).otherwise(F.lit("")),
    )
    response = _record(
        F.col("kind"),
        [
            ("WARC-Record-ID", name("response")),
            *shared,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(F.col("kind") == "revisit", F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", F.when(F.col("kind") == "revisit", name("response", F.concat(F.col("keeper_key"), F.lit(" 1"))))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        http,
    )
    ask = F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("-")), F.lit(" HTTP/1.1" + END))
    tied = ("WARC-Concurrent-To", name("response"))
    request = _record("request", [("WARC-Record-ID", name("request")), *shared, tied, ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    note = lambda n: F.concat(F.lit(f"{n.replace('_', '-')}: "), F.col(n).cast("string"))
    notes = F.concat_ws(EOL, note("page_id"), note("bytes"), note("refers"))
    metadata = _record("metadata", [("WARC-Record-ID", name("metadata")), *shared, tied, ("Content-Type", F.lit("application/warc-fields"))], notes)
    rows = rows.select("bytes", F.array(request, response, metadata).alias("records"))
    room, captures = 1 << 16, []  # bytes of a capture of the class, with its headers
    most = light.agg(F.max("bytes")).first()[0]
    while most is not None and (not captures or captures[-1][1] < most):
        captures.append((captures[-1][1] + 1 if captures else 0, room - 4096, max(1, FILE_BYTES // room)))
        room *= SIZE_STEP
    for least, largest, count in captures or [(0, 0, 1)]:
        of_class = rows.filter(F.col("bytes").between(least, largest)) if len(captures) > 1 else rows
        (
            of_class.select(F.explode("records").alias("value"))
            .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * count)
            .mode("append").text(path)
        )


RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest")]
    + [T.StructField(n, T.BinaryType()) for n in ("http_head", "body")]
    + [T.StructField("body_sha1", T.StringType())]
)


def parse(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of a stream, by Content-Length, one at a time.

    An empty stream has no records.  ValueError if a record does not begin with a version line, has no
    type or length, or is cut off.
    """
    while True:
        line = archive.readline()
        while line in (b"\r\n", b"\n"):  # the two line ends behind a record
            line = archive.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := archive.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a record's headers are cut off")
            key, _, value = line.decode("utf-8").partition(":")
            fields[key.strip().lower()] = value.strip()
        if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
            raise ValueError("a record without type or length")
        block = archive.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("a record's block is cut off")
        yield fields | {"type": fields["warc-type"]}, block


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below path; the body of a response is its payload.

    Header fields that a record lacks are null; other fields, and records of other types, are kept as they are
    read.  Archives without records give no rows; one that is cut off or no archive fails the query.
    A task holds one compressed file and a few records at a time.
    """
    bounded_batches(spark)
    names = {"record_id": "warc-record-id", "concurrent_to": "warc-concurrent-to", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest"}

    def run(batches):
        import hashlib

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if f.dataType == T.BinaryType() else pa.string()) for i, f in enumerate(RECORD.fields)], names=RECORD.names)

        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for h, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 20)):
                    head, _, body = block.partition(END.encode()) if h["type"] in ("response", "revisit") else (b"", b"", block)
                    rows.append((h["type"], *(h.get(n) for n in names.values()), head, body, hashlib.sha1(body).hexdigest()))
                    size += len(block)
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata.

    Records meet through the response's id, which requests and metadata name as concurrent.
    A part that the archive lacks is null; of several alike parts the largest record id stays.  Records
    without a response to belong to are put together under a null capture_id; no records, no rows.
    """
    own = F.col("type").isin("response", "revisit")
    part = F.struct("record_id", "type", "refers_to", "target_uri", "date", "payload_digest", "http_head", "body", "body_sha1")
    return (
        records.withColumn("capture_id", F.when(own, F.col("record_id")).otherwise(F.col("concurrent_to")))
        .groupBy("capture_id")
        .agg(
            F.max(F.when(F.col("type") == "request", part)).alias("request"),
            F.max(F.when(own, part)).alias("response"),
            F.max(F.when(F.col("type") == "metadata", part)).alias("metadata"),
        )
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives, read them back, and assemble the captures."""
    path = shared_dir(pages.sparkSession)
    write_captures(pages, path)
    return assemble(read_records(pages.sparkSession, path))


def digests(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every capture.

    What a revisit leaves out is read from its metadata; a capture without metadata has a null page_id.
    """
    text = F.col("metadata.body").cast("string")
    note = lambda name: F.regexp_extract(text, rf"(?:^|\n){name}: (-?\d+)", 1).try_cast("long")
    full = F.col("response.type") == "response"
    return captures.select(
        note("page-id").alias("page_id"),
        F.when(full, F.octet_length("response.body").cast("long")).otherwise(note("bytes")).alias("payload_bytes"),
        F.when(full, F.col("response.body_sha1")).otherwise(F.substring_index("response.payload_digest", ":", -1)).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        note("refers").alias("refers_to"),
    )
