"""WARC archives of pages: writing captures, reading them back, and assembling each capture's records into one row.

``write`` makes for each page a request, a response (or a revisit of the first capture with the same payload) and a metadata
record; request and metadata name the response in WARC-Concurrent-To. Record ids are made of the page id, the payload's digest and the url.
Pages are put together to pieces of about ``ARCHIVE`` bytes, and Spark's text writer makes a gzip archive of each piece, so an
archive is never larger than that and one page. (Spark has no writer for bytes, so an archive is one gzip member.)

``read`` decompresses archives as streams and cuts records by Content-Length, so a payload may hold anything, WARC headers too.
``assemble`` brings the records of a capture together by their concurrent-to identifiers, one shuffle for all kinds, to one nested
row for each capture; only revisits then meet the responses they refer to.

Defined results: null html is an empty payload. Payloads under ``MIN_SHARED`` bytes are always responses. Among equal payloads the
smallest page id is the response, the others revisit it, those without a page id too; without any page id all are responses.
Repeated page ids with unlike payloads or urls are captures of their own; repeated rows give a row for each. Null urls are written as
``about:blank``. An empty table gives no records. Line ends inside urls become %0D and %0A. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.llm.scratch import drop, shared_dir, written

MIN_SHARED = 100
ARCHIVE = 32_000_000
DATE = "2026-01-01T00:00:00Z"
_END = "\r\n"
RECORD = "warc_type string, record_id string, concurrent_to string, refers_to string, uri string, page_id long, payload_digest string, payload_bytes long, payload binary"


def _record(kind: str, headers: list[tuple[str, Column]], body: Column) -> Column:
    """One record as text; Content-Length counts UTF-8 bytes. The caller adds the record's two line ends."""
    lines = [F.lit(f"WARC/1.1{_END}WARC-Type: {kind}{_END}WARC-Date: {DATE}{_END}")]
    for name, value in headers:
        lines.append(F.concat(F.lit(f"{name}: "), value, F.lit(_END)))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(_END + _END), body)


def captures(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to, refers_url): refers_to and refers_url name the capture whose response holds the payload,
    null for responses.

    Payloads meet by digest and page id alone; the pages are then joined by page id and digest, so a popular payload's texts stay
    spread out.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("about:blank")), "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = rows.where(F.octet_length("html") >= MIN_SHARED).select("page_id", "digest", "url")
    # of one page id under several urls, the smallest url's capture
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    first = large.groupBy("digest").agg(least.alias("least"), F.count("*").alias("n")).where("n > 1 AND least IS NOT NULL")
    first = first.select("digest", F.col("least.page_id").alias("refers_to"), F.col("least.url").alias("refers_url"))
    again = large.select("page_id", "digest").join(first, "digest").where("page_id IS NULL OR refers_to < page_id").distinct()
    again = again.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "refers_to", "refers_url")
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left").select("page_id", "url", "html", "digest", "refers_to", "refers_url")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive values put together up to ARCHIVE characters."""
    run, size = [], 0
    piece = lambda: pa.RecordBatch.from_arrays([pa.array([(_END + _END).join(run)], pa.large_string())], names=["value"])
    for batch in batches:
        for value in batch.column(0).to_pylist():
            if run and size + len(value) > ARCHIVE:
                yield piece()
                run, size = [], 0
            run.append(value)
            size += len(value)
    if run:
        yield piece()


def write(found: DataFrame, path: str) -> None:
    """Archives of captures() in the folder path."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    named = lambda kind, of, url: F.concat(F.lit(f"<urn:x-capture:{kind}:"), of, F.lit(":"), F.col("digest"), F.lit(":"), F.substring(F.sha2(url, 256), 1, 16), F.lit(">"))
    ids = {kind: named(kind, page, F.col("url")) for kind in ("response", "request", "metadata")}
    revisit = F.col("refers_to").isNotNull()
    target = ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    status = F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}{_END}")
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    full = _record("response", [("WARC-Record-ID", ids["response"]), target, digest, http], F.concat(status, F.col("html")))
    refers = named("response", F.col("refers_to").cast("string"), F.col("refers_url"))
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    again = _record("revisit", [("WARC-Record-ID", ids["response"]), target, digest, ("WARC-Refers-To", refers), ("WARC-Profile", profile), http], status)
    joined = ("WARC-Concurrent-To", ids["response"])
    ask = _record("request", [("WARC-Record-ID", ids["request"]), joined, target, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{_END}{_END}")))
    about = _record("metadata", [("WARC-Record-ID", ids["metadata"]), joined, target, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page-id: "), page, F.lit(_END)))
    gap = F.lit(_END + _END)
    value = F.concat(ask, gap, F.when(revisit, again).otherwise(full), gap, about)
    pieces = found.select(value.alias("value")).mapInArrow(_pieces, "value string")
    pieces.write.option("lineSep", _END + _END).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def records(data: BinaryIO) -> Iterator[dict]:
    """The records of one archive, in order. A header without a length or a body cut short ends in an error."""
    while line := data.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := data.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        body = data.read(int(headers["content-length"]))
        if len(body) < int(headers["content-length"]):
            raise ValueError(f"the record {headers.get('warc-record-id')} is cut short")
        yield headers | {"body": body}


def _parsed(r: dict) -> tuple:
    kind, payload = r["warc-type"], None
    if kind == "response":
        payload = r["body"].partition(b"\r\n\r\n")[2]
    page = r["body"].partition(b": ")[2].strip() if kind == "metadata" else None
    digest = hashlib.sha256(payload).hexdigest() if payload is not None else r.get("warc-payload-digest", "").rpartition(":")[2] or None
    return (kind, r["warc-record-id"], r.get("warc-concurrent-to"), r.get("warc-refers-to"), r.get("warc-target-uri"), int(page) if page else None, digest, None if payload is None else len(payload), payload)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives in path. The digest of a response is computed from its payload, not taken from the header."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in RECORD.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

        for files in batches:
            for content in files.column(0):
                rows, size = [], 0
                for r in records(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    rows.append(_parsed(r) if payloads else (*_parsed(r)[:-1], None))
                    size += len(r["body"])
                    if size > 8_000_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(work, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One row for each capture: page_id, request, response and metadata as structs, and the payload's facts (of the response that
    a revisit refers to). A capture whose records are written several times gives as many rows. The rows are written once, in the
    shared folder, and read for captures and for what revisits refer to."""
    part = lambda kinds, *cols: F.max(F.when(F.col("warc_type").isin(kinds), F.struct(*cols)))
    rows = found.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture")).agg(
        part(["request"], "record_id", "uri").alias("request"),
        part(["response", "revisit"], "record_id", "warc_type", "uri", "payload_digest", "payload_bytes", "payload", "refers_to").alias("response"),
        part(["metadata"], "record_id", "page_id").alias("metadata"),
        F.count(F.when(F.col("warc_type").isin("response", "revisit"), 1)).alias("n"),
    )
    rows = written(rows.where("n > 0").select("request", "response", "metadata", F.explode(F.expr("sequence(1L, n)")).alias("copy")).drop("copy"), "captures")
    full = rows.where("response.warc_type = 'response'").withColumns({"payload_bytes": F.col("response.payload_bytes"), "origin": F.lit(None).cast("long")})
    sizes = full.select(F.col("response.record_id").alias("to"), "payload_bytes").dropDuplicates(["to"])
    again = rows.where("response.warc_type = 'revisit'").join(sizes, F.col("response.refers_to") == F.col("to"), "left").drop("to")
    again = again.withColumn("origin", F.regexp_extract("response.refers_to", ":response:([-0-9]+):", 1).try_cast("long"))
    return full.unionByName(again).select(
        F.col("metadata.page_id").alias("page_id"), "request", "response", "metadata", "payload_bytes",
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.warc_type").alias("record_type"), F.col("origin").alias("refers_to"),
    )


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back, and give each capture's nested row with its facts. The
    archives are deleted once their captures are assembled."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(captures(pages), path)
    archives = read(spark, path, payloads)
    out = assemble(archives)
    archives._written_to = path
    drop(archives)
    return out


#: DuckDB SQL with the same result for a table pages(page_id, html).
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS s FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to FROM f
"""
