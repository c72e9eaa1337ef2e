"""WARC archives: written by Spark, read back and assembled into captures.

A page becomes three records: a request, a response (or a revisit of an equal
payload) and metadata. The request and the metadata name the response in
WARC-Concurrent-To; `assemble` joins the three through that identifier into one
nested row per capture, and resolves what revisits refer to.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import shared_path, stored

CRLF = "\r\n"
# Digits of base 32 as Spark writes them, and as RFC 4648 does.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes, before compression, that a file holds about; bytes of payloads that a reader gathers before it passes them on,
#: and of a file that it inflates at once.
FILE_BYTES, READ_BYTES, STEP_BYTES = 128 << 20, 16 << 20, 1 << 18

RECORDS = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, page_id long, payload_bytes long, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 40 bits of it are 8 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _key(page_id: Column, url: Column, digest: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("u"), url), F.lit("null")), digest).cast("binary"))


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line ends that close it: the writer adds those."""
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), record_id]
    for name, value in headers:
        lines += [F.when(value.isNotNull(), F.concat(F.lit(f"{CRLF}{name}: "), value)).otherwise(F.lit(""))]
    return F.concat(*lines, F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def records(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The text of three records for each row of (page_id, url, html).

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the
    smallest page_id are responses, the others revisit them; shorter payloads and those
    with null page_ids only are responses. A null html is empty. Rows that repeat page, url and
    payload are captures of their own. The html is shuffled once, by the capture's key.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).alias("size"), base32_sha1(html.cast("binary")).alias("digest"))
    rows = rows.withColumn("key", _key(F.col("page_id"), F.col("url"), F.col("digest")))
    slim = rows.select("key", "digest", "page_id", "url", "size")
    first = slim.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"))
    origin = (
        slim.where(F.col("size") >= least_bytes)
        .join(first, "digest")
        .where(F.col("page_id").isNull() | (F.col("page_id") > F.col("first.page_id")))
        .select("key", _key(F.col("first.page_id"), F.col("first.url"), F.col("digest")).alias("origin"))
        .dropDuplicates(["key"])
    )
    n = F.row_number().over(Window.partitionBy("key").orderBy("digest")).cast("string")
    rows = rows.withColumn("n", n).join(origin, "key", "left")
    own = _urn(F.col("key"), F.col("n"), F.lit("response"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    about = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    response = _record("response", own, [*about, digest, http], F.concat(head, "html"))
    back = [("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _urn(F.col("origin"), F.lit("1"), F.lit("response")))]
    revisit = _record("revisit", own, [*about, digest, *back, http], head)
    host = F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    request = _record(
        "request", _urn(F.col("key"), F.col("n"), F.lit("request")),
        [*about, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)),
    )
    metadata = _record(
        "metadata", _urn(F.col("key"), F.col("n"), F.lit("metadata")),
        [*about, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
    )
    return rows.select(F.explode(F.array(request, F.when(F.col("origin").isNull(), response).otherwise(revisit), metadata)).alias("value"))


def write(pages: DataFrame, path: str, compression: str = "gzip", **options) -> None:
    """Write archives under ``path``: Spark's text files whose line end is that of a WARC record.

    A file ends after as many records as are FILE_BYTES at their mean size.
    """
    mean = pages.agg(F.avg(F.octet_length(F.coalesce("html", F.lit(""))))).first()[0] or 0
    out = records(pages, **options).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", 3 * max(1, int(FILE_BYTES / (mean + 1000))))
    out.option("compression", compression).text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """A file's bytes, a step at a time; gzip members are inflated."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(view), STEP_BYTES):
            yield bytes(view[at : at + STEP_BYTES])
        return
    member = zlib.decompressobj(31)
    for at in range(0, len(view), STEP_BYTES):
        part = bytes(view[at : at + STEP_BYTES])
        while part:
            if member.eof:
                member = zlib.decompressobj(31)
            yield member.decompress(part)
            part = member.unused_data
    if not member.eof:
        raise ValueError("the last gzip member has no end")


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, with lower-case names, and block of each record of a file, of which one is held at a time."""
    steps, buffer, at, done = _inflated(data), bytearray(), 0, 0

    def upto(size: int) -> bool:
        while len(buffer) < size:
            more = next(steps, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while upto(at + 1):
        looked = at
        while (end := buffer.find(b"\r\n\r\n", looked)) < 0:
            looked = max(at, len(buffer) - 3)
            if not upto(len(buffer) + 1):
                raise ValueError(f"the record at byte {done + at} has no headers' end")
        version, *lines = bytes(buffer[at:end]).split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {done + at}")
        headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
        at = end + 4 + int(headers["content-length"])
        if not upto(at + 4) or buffer[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {done + at} has another length")
        yield headers, bytes(buffer[end + 4 : at])
        at += 4
        if at > 4 * STEP_BYTES:
            del buffer[:at]
            done, at = done + at, 0


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives under ``path``; see RECORDS.

    ``payloads``: whether to return them; sizes and digests are of the payloads read
    in either case. A payload that doesn't have the digest of its record raises an error. Records that repeat come as
    often as they were written; a folder without archives gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})
        for batch in batches:
            for data in batch["content"]:
                rows, held = [], 0
                for h, block in parsed(data):
                    kind, page_id, size, payload = h["warc-type"], None, None, None
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{h['warc-record-id']} has another digest")
                    elif kind == "metadata" and block.startswith(b"pageId: "):
                        page_id = int(block[8:])
                    rows.append((h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h["warc-date"], digest, page_id, size, payload if payloads else None))
                    held += len(payload or b"") if payloads else 0
                    if held >= READ_BYTES or len(rows) >= 10_000:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, RECORDS)


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: capture_id and the structs request, response and metadata.

    Records are joined on WARC-Concurrent-To; the request or the metadata of a capture
    may be missing (null). In ``response``, a revisit has the size of the payload that it refers to,
    and origin_page_id is that response's page. Each response or revisit record makes a row, so captures that were
    written twice come twice, each with either's request and metadata; no records give no rows.
    """
    part = ["record_id", "target_uri", "date"]
    own = found.where(F.col("type").isin("response", "revisit"))
    request = found.where("type = 'request'").select(F.col("concurrent_to").alias("capture_id"), F.struct(*part).alias("request"))
    metadata = found.where("type = 'metadata'").select(F.col("concurrent_to").alias("capture_id"), F.struct(*part, "page_id").alias("metadata"))
    joined = own.withColumnRenamed("record_id", "capture_id").join(request, "capture_id", "left").join(metadata, "capture_id", "left")
    origin = joined.where("type = 'response'").select(
        F.col("capture_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("metadata.page_id").alias("_page_id")
    )
    resolved = joined.where("type = 'revisit'").join(origin, "refers_to", "left")
    whole = joined.where("type = 'response'").withColumns({"_bytes": F.col("payload_bytes"), "_page_id": F.lit(None).cast("long")})
    response = F.struct(
        "type", "target_uri", "date", "payload_digest", F.col("_bytes").alias("payload_bytes"), "payload", "refers_to", F.col("_page_id").alias("origin_page_id")
    )
    return whole.unionByName(resolved).select("capture_id", "request", response.alias("response"), "metadata")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and return a row per page.

    Null html is an empty payload; null page_ids stay null and never are what others refer to; repeated
    rows are captures of their own; an empty table gives no row. Columns besides page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, least_bytes=least_bytes)
    return assemble(stored(read(spark, path, payloads=False), "warc-records")).select(
        "metadata.page_id",
        "response.payload_bytes",
        "response.payload_digest",
        F.col("response.type").alias("record_type"),
        F.col("response.origin_page_id").alias("refers_to"),
    )
