"""WARC: write captures as transactions, read archives back, assemble one nested row per capture.

A transaction is a request, a response (or a revisit, where an equal payload is archived already) and
a metadata record; request and metadata name the response in WARC-Concurrent-To. Files are plain WARC
1.1 in gzip, written and read by Spark's text source with the record end CRLF CRLF as its separator,
so any store that Spark reaches will do, files need not fit in memory, and lost tasks are run again.

Defined cases: a null payload is empty; a null identifier counts as the largest when the first of
equal payloads is sought; rows that repeat an identifier each give a capture, and repeated rows that
hold the smallest identifier are all responses; records of a transaction that lack a response still
give a row, with the missing parts null; a record cut off by the end of a file is dropped and counted
in no row. Extra columns, whatever their names, are ignored; an empty table has no captures.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, keep, map_arrow, shared_dir

GAP = b"\r\n\r\n"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  #: pages carry no time of capture
BATCH_BYTES = 8 << 20


def bare_digest(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, block: bytes, content: str, *more: tuple[str, str]) -> bytes:
    """One record without the CRLF CRLF that ends it."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *more, ("Content-Type", content), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in head).encode() + GAP + block


def clean_uri(uri: str | None) -> str:
    return re.sub(r"\s", "%20", uri or "about:blank")


def transactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, payload, first) -> three records each; record ids hold the row's identifier and a unique part."""
    schema = pa.schema([("value", pa.binary())])
    names = iter(lambda: uuid.uuid4().hex, None)
    for batch in batches:
        out, held = [], 0
        for row_id, url, payload, first in zip(*(batch.column(c).to_pylist() for c in ("row_id", "url", "payload", "first")), strict=True):
            own, uri, part = "none" if row_id is None else str(row_id), clean_uri(url), next(names)
            target = f"urn:capture:{own}:{part}"
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            digest, joined = ("WARC-Payload-Digest", f"sha1:{bare_digest(payload)}"), ("WARC-Concurrent-To", f"<{target}>")
            if first == row_id:
                main = record("response", target, uri, http + payload, "application/http; msgtype=response", digest)
            else:
                main = record("revisit", target, uri, http, "application/http; msgtype=response", digest, ("WARC-Profile", SAME), ("WARC-Refers-To", f"<urn:capture:{first}:first>"))
            path = re.sub(r"^[a-z]+://[^/]*", "", uri) or "/"
            asked = record("request", f"urn:request:{own}:{part}", uri, f"GET {path} HTTP/1.1\r\n\r\n".encode(), "application/http; msgtype=request", joined)
            facts = record("metadata", f"urn:metadata:{own}:{part}", uri, f"row-id: {own}\r\npayload-bytes: {len(payload)}".encode(), "application/warc-fields", joined)
            out += [asked, main, facts]
            held += len(main)
            if held > BATCH_BYTES:
                yield batch_of(schema, [out])
                out, held = [], 0
        if out:
            yield batch_of(schema, [out])


def first_of_equal(pages: DataFrame, row_id: str, payload: str) -> DataFrame:
    """(row_id, url, payload, first): ``first`` is the smallest identifier with an equal payload. Digests are counted from
    narrow rows, and the counts are written before they are joined: the pages of a payload that many share then come in an
    exchange of their own, which adaptive execution splits over tasks."""
    rows = pages.select(F.col(row_id).cast("long").alias("row_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha", F.sha1("payload"))
    firsts = keep(pages.sparkSession, rows.groupBy("sha").agg(F.min("row_id").alias("first")), "firsts")
    return rows.join(firsts.hint("merge"), "sha").select("row_id", "url", "payload", "first")


def write_archives(pages: DataFrame, path: str, row_id: str = "page_id", payload: str = "html") -> None:
    """Write a transaction for each row of ``pages`` (identifier, url, payload) as .gz archives under ``path``."""
    lines = map_arrow(first_of_equal(pages, row_id, payload), transactions, "value binary")
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


RECORD = pa.schema(
    [("record_id", pa.string()), ("kind", pa.string()), ("capture_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("http_head", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
RECORD_DDL = "record_id string, kind string, capture_id string, uri string, date string, refers_to string, digest string, http_head string, payload_bytes long, payload binary"


def header_fields(head: bytes) -> dict[str, str]:
    """Names in lower case; a folded line goes on the line before."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parsed(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    own, kind = head.get("warc-record-id", "").strip("<>"), head.get("warc-type", "")
    to, refers = head.get("warc-concurrent-to", "").strip("<>"), head.get("warc-refers-to", "").strip("<>")
    http, payload, digest, size = None, None, None, None
    if kind in ("response", "revisit", "request"):
        top, _, body = block.partition(GAP)
        http = top.decode("utf-8", "replace")
        if kind == "response":
            payload, digest, size = body, bare_digest(body), len(body)
        elif kind == "revisit":
            digest = head.get("warc-payload-digest", "").rpartition(":")[2] or None
            length = header_fields(top).get("content-length", "")
            size = int(length) if length.isdigit() else None
    elif kind == "metadata":
        payload = block
    at_center = kind in ("response", "revisit", "resource") or not to
    return own, kind, own if at_center else to, head.get("warc-target-uri"), head.get("warc-date"), refers or None, digest, http, size, payload if with_payload or kind == "metadata" else None


def record_reader(with_payload: bool):
    """Joins the pieces between CRLF CRLF back into records by their Content-Length, file after file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, head, parts, size, want, out, held = None, None, [], 0, 0, [], 0
        for batch in batches:
            for name, piece in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if name != file:
                    file, head, parts = name, None, []
                if head is None:
                    at = piece.find(b"WARC/")
                    if at < 0 or piece[:at].strip():
                        continue  # between records
                    head = header_fields(piece[at:])
                    length = head.get("content-length", "0")
                    want, parts, size = int(length) if length.isdigit() else 0, [], -len(GAP)
                    continue
                parts.append(piece)
                size += len(GAP) + len(piece)
                if size + len(GAP) >= want:  # a block that ends in CR LF shares bytes with the CRLF CRLF after it
                    block = (GAP.join(parts) + GAP)[:want]
                    out.append(parsed(head, block, with_payload))
                    held += len(block)
                    head = None
                    if held > BATCH_BYTES or len(out) >= 2000:
                        yield batch_of(RECORD, list(zip(*out, strict=True)))
                        out, held = [], 0
        if out:
            yield batch_of(RECORD, list(zip(*out, strict=True)))

    return read


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``. A gzip file is one task's, read as a stream."""
    pieces = spark.read.option("lineSep", "\r\n\r\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return map_arrow(pieces, record_reader(with_payload), RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response or revisit, and all metadata that names it."""
    part = F.struct("record_id", "kind", "date", "uri", "refers_to", "digest", "http_head", "payload_bytes", "payload")
    main = F.col("kind").isin("response", "revisit", "resource")
    return records.groupBy("capture_id").agg(
        F.min(F.when(F.col("kind") == "request", part)).alias("request"),
        F.min(F.when(main, part)).alias("response"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "metadata", part))).alias("metadata"),
    )


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and give each capture's facts."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path)
    captures = assemble(read_records(spark, path, with_payload=False))
    number = lambda urn: F.regexp_extract(urn, r"^urn:capture:(-?\d+):", 1).try_cast("long")
    return captures.select(
        number("capture_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        number("response.refers_to").alias("refers_to"),
        F.col("response.uri").alias("uri"),
        F.size("metadata").alias("n_metadata"),
        F.col("request").isNotNull().alias("has_request"),
    )
