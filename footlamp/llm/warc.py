"""WARC archives: writing, reading and revisit resolution.

Archives are written by Spark's text sink, so a lost task leaves no half archive, and read as binary files, so
any store that Spark reaches will do. A record is UTF-8 from end to end; the sink adds its last line break.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footlamp.llm.registry import query, table
from footlamp.plans.storage import cut_lineage, scratch_dir

#: Equal payloads of fewer bytes are cheaper to store again than to refer to.
LEAST_BYTES = 100
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives carry this date unless another is given, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
FIELDS = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, url string"


def header_text(value: Column) -> Column:
    """A header value on one line: percent signs, controls and blanks at risk are percent-encoded."""
    for char, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), ("\0", "%00")):
        value = F.replace(value, F.lit(char), F.lit(code))
    return value


def record_id(page_id: Column) -> Column:
    """A record id that names the page; a null page id has an empty name."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def resolve(pages: DataFrame, key: str = "page_id", digest: str = "payload_digest", size: str = "payload_bytes") -> DataFrame:
    """Add ``record_type`` and ``refers_to`` to record headers.

    Headers are shuffled by payload digest. Only digests that several records share are kept for the join, and
    each gathers a minimum per task first, so a payload that a third of all records carry is no hot group. The
    other side of the join is the whole table; Spark splits its hot digests, or sends out the small side.
    """
    shared = (
        pages.where(F.col(size) >= LEAST_BYTES)
        .groupBy(F.col(digest).alias("shared"))
        .agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("shared", "first")
    )
    met = pages.join(shared, F.col(digest) == F.col("shared"), "left")
    revisits = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col(key)) & (F.col(size) >= LEAST_BYTES)
    kind = F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))
    return met.select(*pages.columns, kind.alias("record_type"), F.when(revisits, F.col("first")).alias("refers_to"))


def records(resolved: DataFrame, date: str = DATE) -> DataFrame:
    """One column ``value``: a whole record per row, without its last line break.

    Input: ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``.
    """
    is_revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(CRLF * 2),
    )
    body = F.when(is_revisit, http).otherwise(F.concat(http, F.coalesce("payload", F.lit(""))))
    target = F.when(F.col("url").isNull(), F.lit("")).otherwise(F.concat(F.lit("WARC-Target-URI: "), header_text(F.col("url")), F.lit(CRLF)))
    refers = F.when(is_revisit, F.concat(
        F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")), F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}")
    )).otherwise(F.lit(""))
    with_body = resolved.withColumn("body", body)
    return with_body.select(
        F.concat(
            F.lit(f"{VERSION}{CRLF}WARC-Type: "), F.col("record_type"),
            F.lit(f"{CRLF}WARC-Record-ID: "), record_id(F.col("page_id")),
            F.lit(f"{CRLF}WARC-Date: {date}{CRLF}"), target, refers,
            F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
            F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
            F.octet_length("body").cast("string"), F.lit(CRLF * 2), F.col("body"), F.lit(CRLF),
        ).alias("value")
    )


def write_archives(resolved: DataFrame, path: str, date: str = DATE) -> None:
    """Write records as gzip archives below ``path``, one per partition of the input."""
    records(resolved, date).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers and block of every record of an archive, by declared length, so blocks may hold anything."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = {k.strip().lower(): v for k, v in FIELD.findall(data, data.index(b"\r\n", at) + 2, end)}
        stop = end + int(head[b"content-length"])
        if stop > len(data):
            raise ValueError("an archive ends inside a record")
        yield head, data[end:stop]
        at = stop
        while data[at : at + 2] == b"\r\n":
            at += 2


def page_of(value: bytes | None) -> int | None:
    digits = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(digits) if digits else None


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows: list[tuple] = []
            held = 0
            for head, block in parse(memoryview(content.as_buffer()).tobytes()):
                kind = head[b"warc-type"].decode()
                body = block[block.index(b"\r\n\r\n") + 4 :]
                digest = hashlib.sha256(body).hexdigest() if kind == "response" else None
                if digest is not None and head[b"warc-payload-digest"] != b"sha256:" + digest.encode():
                    raise ValueError("a payload does not have its digest")
                url = head.get(b"warc-target-uri")
                if url is not None:
                    url = re.sub(rb"%(25|0D|0A|00)", lambda m: bytes([int(m[1], 16)]), url).decode()
                own = head[b"warc-payload-digest"].decode().removeprefix("sha256:")
                size = len(body) if kind == "response" else None
                rows.append((page_of(head[b"warc-record-id"]), kind, page_of(head.get(b"warc-refers-to")), size, own, url, body if payloads else None))
                held += len(body) if payloads else 0
                if len(rows) >= 5000 or held > 16_000_000:
                    yield _batch(rows, payloads)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, payloads)


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "url", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    n = len(names) if payloads else len(names) - 1
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows))[:n], kinds)], names[:n])


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The record headers of all archives below ``path``, with the payloads when asked.

    Every payload is held against its digest; a cut archive or a wrong digest fails the job. An archive is
    read by one task, so archives should be of a size that fits, as is usual for this format.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(lambda batches: _read(batches, payloads), FIELDS + (", payload binary" if payloads else ""))


def join_revisits(found: DataFrame) -> DataFrame:
    """Give revisit records the payload size (and payload) of the response they refer to.

    The responses that are referred to are found per task first; hot ones are split by Spark's skew join.
    """
    extra = ["payload"] if "payload" in found.columns else []
    originals = found.where("record_type = 'response' AND page_id IS NOT NULL").select(
        F.col("page_id").alias("original"), F.col("payload_digest").alias("original_digest"),
        F.col("payload_bytes").alias("original_bytes"), *[F.col(c).alias(f"original_{c}") for c in extra],
    )
    met = found.where("record_type = 'revisit'").join(
        originals.dropDuplicates(["original", "original_digest"]),
        (F.col("refers_to") == F.col("original")) & (F.col("payload_digest") == F.col("original_digest")),
        "left",
    )
    filled = {"payload_bytes": F.col("original_bytes"), **{c: F.col(f"original_{c}") for c in extra}}
    revisits = met.select(*[filled.get(c, F.col(c)).alias(c) for c in found.columns])
    return found.where("record_type = 'response'").unionByName(revisits)


def payload_headers(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest`` of a table of pages; a null payload is empty."""
    text = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(
        F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), text.alias("payload"),
        F.octet_length(text).cast("bigint").alias("payload_bytes"), F.sha2(text, 256).alias("payload_digest"),
    )


def archive_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write deduplicated archives of a table of pages: responses, and revisits of equal payloads.

    Of equal payloads of at least 100 bytes the smallest id is the response. Rows that share that id and payload
    are responses all; a null id is a revisit unless all ids of the payload are null. Null and empty payloads
    are empty responses, null urls leave out the header. An empty table writes no record.
    """
    write_archives(resolve(payload_headers(pages, key, url, payload)), path)


def deduplicate_archives(spark: SparkSession, source: str, path: str) -> None:
    """Read archives, resolve equal payloads to revisits, and write them anew with fresh headers.

    Revisits that are there already get their original's payload before they are resolved again.
    """
    found = join_revisits(read_archives(spark, source, payloads=True)).drop("record_type", "refers_to")
    write_archives(resolve(found.withColumn("payload", F.col("payload").cast("string"))), path)


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN g.first IS NOT NULL AND g.first IS DISTINCT FROM p.page_id AND p.payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.first IS NOT NULL AND g.first IS DISTINCT FROM p.page_id AND p.payload_bytes >= 100 THEN g.first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


@query("op7_warc", SQL)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives in the shared folder and read back."""
    path = scratch_dir(spark, "warc")
    archive_pages(table(spark, sf_dir, "pages"), path)
    found = join_revisits(cut_lineage(read_archives(spark, path)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
