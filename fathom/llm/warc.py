"""WARC archives with revisit resolution.

Records are written as WARC/1.1 files, read back by the lengths their headers state, and deduplicated:
headers alone are shuffled by payload digest, the response of each digest is chosen, revisit records
are joined with the original responses they stand for, and new archives are written whose records have
fresh headers.

How it scales. Archives are written by Spark's text writer, whose line separator is the pair of line
ends that closes a WARC record, so that the commit protocol covers lost executors and nothing is
written outside the shared folder. Choosing the responses is a maximum by digest, combined map-side,
over headers of a hundred bytes or so; a digest of a third of all rows costs no more than others. The
payloads are shuffled once, by the key that is unique, not by digest (once more where there are large ones, which are written apart). Archives
are bounded by records and bytes, and read a record at a time, whether they are one gzip member or one a record.

Defined cases. When read, records other than responses and revisits are skipped. A null payload is an empty one. A null url is written as an empty header. Records with
payloads under ``least`` bytes are never revisits. Rows that repeat a key are one record each, and equal
ones of the largest key are all responses. An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path
from .graph import spread_join

END = "\r\n\r\n"
CRLF = "\r\n"
RECORD_ID = "urn:page:"
HEADERS = "record_key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def records(rows: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """Response records (record_key, url, payload, payload_bytes, payload_digest) of a table."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return rows.select(F.col(key).cast("long").alias("record_key"), F.col(url).alias("url"), body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body.cast("binary")).alias("payload_digest"))


def resolve_revisits(headers: DataFrame, least: int = 1000) -> DataFrame:
    """record_key, payload_digest and refers_to, once each, of the records that revisit another: of equal payloads the largest key is the response."""
    large = headers.where(F.col("payload_bytes") >= least).select("record_key", "payload_bytes", "payload_digest")
    original = large.groupBy("payload_digest", "payload_bytes").agg(F.max("record_key").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = spread_join(large.withColumnRenamed("payload_bytes", "__bytes"), original, "payload_digest", F.xxhash64("record_key"))
    return found.where("__bytes = payload_bytes and record_key != refers_to").select("record_key", "payload_digest", "refers_to").distinct()


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", "")


def formatted(rows: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """rows of records() with refers_to (null: response) to one WARC record each, without the closing line ends."""
    revisit = F.col("refers_to").isNotNull()
    payload = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    length = F.octet_length(http) + F.octet_length(payload)
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(F.col("record_key").cast("string"), F.lit("")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _clean(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", F.concat(F.lit(f"<{RECORD_ID}"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(CRLF),
    )
    return rows.select(F.concat(head, http, payload).alias("value"))


#: Payloads up to here share files; larger ones are written apart, as many to a file as its bytes allow.
SMALL_BYTES, FILE_BYTES = 1 << 18, 1 << 29


def write_warc(rows: DataFrame, path: str, max_records: int = FILE_BYTES // SMALL_BYTES) -> None:
    """Gzipped WARC files of at most ``max_records`` records and about ``FILE_BYTES`` each (a larger record is a file)."""

    def write(part: DataFrame, most: int, mode: str = "error") -> None:
        formatted(part).write.mode(mode).option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)

    largest = rows.agg(F.max("payload_bytes")).first()[0] or 0
    write(rows.where(F.col("payload_bytes") <= SMALL_BYTES) if largest > SMALL_BYTES else rows, max_records)
    if largest > SMALL_BYTES:
        write(rows.where(F.col("payload_bytes") > SMALL_BYTES), max(1, min(max_records, FILE_BYTES // largest)), "append")


def unzipped(data: bytes) -> BinaryIO:
    """An archive's bytes as they are asked for: of all its gzip members, a file or a record each, or as they stand."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def parse(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case names, and block of each record of an archive, one at a time."""
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record at the place where one should begin")
        head = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = archive.read(size)
        if len(block) != size or archive.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is not closed")
        yield head, block


def _key(value: str) -> int | None:
    number = value.strip("<>").removeprefix(RECORD_ID)
    return int(number) if number else None


def _record(head: dict[str, str], block: bytes) -> tuple:
    """Key, url, type, what it refers to, payload's size and digest, and the payload, which a revisit has not."""
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = {k.strip().lower(): v for k, _, v in (x.partition(":") for x in http.decode(errors="replace").split(CRLF)[1:])}
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if len(digest) == 32:  # base 32, as many archives have it
        digest = base64.b32decode(digest).hex()
    revisit = head["warc-type"] == "revisit"
    size = int(stated["content-length"]) if "content-length" in stated else None if revisit else len(payload)
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload is not what its header says")
    refers = _key(head["warc-refers-to"]) if revisit and "warc-refers-to" in head else None
    return _key(head["warc-record-id"]), head.get("warc-target-uri", ""), head["warc-type"], refers, size, digest, None if revisit else payload.decode()


def _read(with_payload: bool, batch_bytes: int = 8 << 20):
    names = [x.split()[0] for x in HEADERS.split(", ")] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_payload

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for head, block in parse(unzipped(content.as_py())):
                    if head["warc-type"] in ("response", "revisit"):
                        rows.append(_record(head, block))
                        held += len(block) + 200
                    if held > batch_bytes:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives of a folder; payloads are checked against their digests."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(with_payload), HEADERS + ", payload string" * with_payload)


def deduplicate(rows: DataFrame, path: str, least: int = 1000) -> None:
    """Write records() of a table as archives in which equal payloads stand once."""
    revisits = resolve_revisits(rows.select("record_key", "payload_bytes", "payload_digest"), least)
    write_warc(rows.join(revisits, ["record_key", "payload_digest"], "left"), path)


def op5_warc(spark, sf_dir):
    from .common import table

    path = fresh_path(spark, "archives")
    deduplicate(records(table(spark, sf_dir, "pages"), "page_id", "url", "html"), path)
    return read_warc(spark, path).select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op5_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        l AS (SELECT payload_digest AS d, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN last != page_id THEN last END AS refers_to
        FROM p LEFT JOIN l ON payload_bytes >= 1000 AND payload_digest = d
    """
}
