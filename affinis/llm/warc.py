"""WARC archives as a chunked record table.

Writing: every page is one WARC record.  A payload longer than
``chunk_chars`` code points is written as segments (the standard's
``continuation`` records), so no archive row is larger than a chunk, and
an archive file holds at most ``RECORDS_PER_FILE`` of them.  Spark's text
writer writes the files, so they go to any file system Spark can reach
and survive lost executors.  Of records with equal payloads of at least
``min_revisit`` bytes, the one with the smallest page id is the response
and the others are revisit records without payload.

Reading: archives are unpacked as a stream and framed by Content-Length,
never by searching for record starts.  The result is one row per chunk
with the record's id, the chunk number and the SHA-256 of the payload up
to the end of that chunk; a task holds one chunk at a time.  Segments that
lie in different files keep their bytes and are digested in chunk order
after one shuffle by record id.

Cases: a null payload counts as empty; payloads shorter than
``min_revisit`` are always responses; rows that repeat the smallest page id
are all responses; a null page id is written without the header and read
back as null (it is a response only if all equal payloads lack an id);
a null url is written as empty.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.session import scratch_path

CHUNK_CHARS = 1 << 16
RECORDS_PER_FILE = 1024
READ_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --------------------------------------------------------------------------
# writing
# --------------------------------------------------------------------------
def assign_types(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to).

    Only ids and digests are grouped; payloads are shuffled once, by page
    id, so a group of equal payloads never meets in one task.
    """
    base = pages.select(
        F.col("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")) \
        .withColumn("payload_bytes", F.octet_length("html").cast("long")) \
        .withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    keys = base.where(F.col("payload_bytes") >= min_revisit).select("page_id", "payload_digest")
    firsts = keys.groupBy("payload_digest").agg(
        F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")) \
        .where("_n > 1").drop("_n")
    # one row per page id and digest: repeated rows must not multiply
    revisits = keys.join(firsts, "payload_digest") \
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    return base.alias("b").join(
        revisits.alias("r"),
        F.col("b.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("b.payload_digest") == F.col("r.payload_digest")),
        "left").select("b.*", "r.refers_to")


def _field(name: str, value) -> F.Column:
    """One header line; absent for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def write_archives(pages: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS,
                   min_revisit: int = 100) -> None:
    """Write gzipped WARC 1.1 files below ``path``."""
    typed = assign_types(pages, min_revisit).withColumn("_rid", F.expr("uuid()"))
    revisit = F.col("refers_to").isNotNull()
    chunks = F.when(revisit, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil(F.length("html") / F.lit(chunk_chars)).cast("int")))
    rows = typed.withColumn("_n", chunks).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    first, last, many = F.col("_k") == 1, F.col("_k") == F.col("_n"), F.col("_n") > 1
    body = F.when(revisit, F.lit("")).otherwise(F.concat(
        F.when(first, F.lit(HTTP_HEAD)).otherwise(F.lit("")),
        F.when(many, F.substring(F.col("html"), (F.col("_k") - 1) * chunk_chars + 1, F.lit(chunk_chars)))
        .otherwise(F.col("html"))))
    rows = rows.withColumn("_body", body)
    http = len(HTTP_HEAD)
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).when(first, F.lit("response"))
               .otherwise(F.lit("continuation"))),
        _field("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.when(first, F.col("_rid")).otherwise(
            F.concat("_rid", F.lit("."), "_k")), F.lit(">"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", F.when(first, F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20"))),
        _field("WARC-Page-ID", F.when(first, F.col("page_id"))),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), "payload_digest"))),
        _field("WARC-Payload-Length", F.when(revisit, F.col("payload_bytes"))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("WARC-Refers-To-Page-ID", F.col("refers_to")),
        _field("WARC-Segment-Number", F.when(many, F.col("_k"))),
        _field("WARC-Segment-Origin-ID", F.when(~first, F.concat(F.lit("<urn:uuid:"), "_rid", F.lit(">")))),
        _field("WARC-Segment-Total-Length", F.when(many & last, F.col("payload_bytes") + http)),
        _field("Content-Type", F.when(first & ~revisit, F.lit("application/http;msgtype=response"))),
        _field("Content-Length", F.octet_length("_body")),
        F.lit(CRLF))
    (rows.select(F.concat(head, "_body", F.lit(CRLF)).alias("value"))
     .write.option("lineSep", CRLF).option("maxRecordsPerFile", RECORDS_PER_FILE)
     .option("compression", "gzip").mode("error").text(path))


# --------------------------------------------------------------------------
# reading
# --------------------------------------------------------------------------
class Piece(NamedTuple):
    """A part of one record's block; ``head`` is shared by its pieces."""

    head: dict[str, str]
    data: bytes
    ends: bool


class _Stream:
    """Bytes of one archive file, unpacked a piece at a time."""

    def __init__(self, packed: bytes):
        self.rest, self.buffer = memoryview(packed), bytearray()
        self.plain = bytes(packed[:2]) != b"\x1f\x8b"
        self.member = None if self.plain else zlib.decompressobj(31)

    def more(self) -> bool:
        while len(self.rest):
            if self.plain:
                self.buffer += self.rest[:READ_BYTES]
                self.rest = self.rest[READ_BYTES:]
                return True
            if self.member.eof:
                self.member = zlib.decompressobj(31)
            step = self.rest[:READ_BYTES // 8]
            out = self.member.decompress(step, READ_BYTES)
            left = len(self.member.unconsumed_tail) + len(self.member.unused_data)
            self.rest = self.rest[len(step) - left:]
            if out:
                self.buffer += out
                return True
            if not left and not len(self.rest):
                break
        return False

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        out = bytes(self.buffer[:found])
        del self.buffer[:found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def read_pieces(packed: bytes, size: int = READ_BYTES) -> Iterator[Piece]:
    """Records of one archive as pieces of at most ``size`` bytes."""
    stream = _Stream(packed)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = int(fields["content-length"])
        while True:
            data = stream.take(min(left, size))
            if left and not data:
                raise ValueError("archive ends inside a record")
            left -= len(data)
            yield Piece(fields, data, left == 0)
            if not left:
                break
        stream.take(4)


CHUNKS = pa.schema([
    ("record_id", pa.string()), ("chunk_no", pa.int64()), ("page_id", pa.string()), ("url", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.string()), ("n_bytes", pa.int64()),
    ("running_digest", pa.string()), ("last", pa.bool_()), ("data", pa.binary())])
CHUNK_DDL = ("record_id string, chunk_no long, page_id string, url string, record_type string, refers_to string, "
             "n_bytes long, running_digest string, last boolean, data binary")


def chunk_rows(packed: bytes, keep_data: bool) -> Iterator[dict]:
    """Chunk rows of one archive file.

    ``running_digest`` covers the payload up to the chunk's end and is null
    when an earlier segment lies in another file.  Without ``keep_data``
    only segments keep their bytes, as their record may go on elsewhere.
    """
    record, sha, number, in_http = "", None, 0, False
    for p in read_pieces(packed):
        f = p.head
        kind = f.get("warc-type", "")
        if kind not in ("response", "resource", "revisit", "continuation"):
            continue
        own = (f.get("warc-segment-origin-id") or f["warc-record-id"]).strip("<>")
        segment = int(f.get("warc-segment-number", 1))
        if own != record or (number >> 24) not in (segment, segment - 1):
            sha = hashlib.sha256() if kind != "continuation" else None
            number, in_http = (segment << 24) - 1, "application/http" in f.get("content-type", "")
        if (number >> 24) != segment and (number + 1) >> 24 != segment:
            number = (segment << 24) - 1
        record, number = own, number + 1
        data = p.data
        if in_http and kind == "response":
            at = data.find(b"\r\n\r\n")
            data, in_http = data[at + 4:] if at >= 0 else data, False
        last = p.ends and ("warc-segment-number" not in f or "warc-segment-total-length" in f)
        row = {"record_id": own, "chunk_no": number, "page_id": f.get("warc-page-id"), "url": f.get("warc-target-uri"),
               "record_type": kind, "refers_to": f.get("warc-refers-to-page-id"), "n_bytes": len(data),
               "running_digest": None, "last": last, "data": data}
        if kind == "revisit":
            row |= {"n_bytes": int(f.get("warc-payload-length", 0)), "data": None,
                    "running_digest": f.get("warc-payload-digest", "").removeprefix("sha256:")}
        elif sha is not None:
            sha.update(data)
            row["running_digest"] = sha.hexdigest()
            if not keep_data and "warc-segment-number" not in f:
                row["data"] = None
        yield row


def read_chunks(spark: SparkSession, path: str, keep_data: bool = True) -> DataFrame:
    """Chunk table of all archives below ``path``.

    Archive files are read whole while packed; the writer's bound on
    records per file bounds them.  Payloads are unpacked chunk by chunk.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, size = [], 0
                for row in chunk_rows(b.column(0)[i].as_py(), keep_data):
                    rows.append(row)
                    size += 200 + len(row["data"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, CHUNKS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, CHUNKS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(parse, CHUNK_DDL)


RECORDS = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
RECORD_DDL = ("record_id string, page_id string, url string, record_type string, refers_to string, "
              "payload_bytes long, payload_digest string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, with the payload's length and digest.

    Chunks meet by record id in chunk order and are digested one at a time.
    A record without segments was digested while it was read and travels
    without its bytes.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        sha, size, out = None, 0, []
        for b in batches:
            for row in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                if now is None or row["record_id"] != now["record_id"]:
                    if now is not None:
                        out.append(now)
                    now = {k: row[k] for k in ("record_id", "page_id", "url", "record_type", "refers_to")}
                    sha, size = hashlib.sha256(), 0
                size += row["n_bytes"]
                known = row["running_digest"]
                if row["data"] is not None:
                    sha.update(row["data"])
                    known = known or sha.hexdigest()
                now |= {"payload_bytes": size, "payload_digest": known}
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, RECORDS)
                out = []
        if now is not None:
            out.append(now)
        if out:
            yield pa.RecordBatch.from_pylist(out, RECORDS)

    chunks = read_chunks(spark, path, keep_data=False)
    ordered = chunks.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return ordered.mapInArrow(digest, RECORD_DDL)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_records(spark, path).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""
