"""A content-addressed web archive: payload bytes once by digest, exact record headers beside them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_BATCH_BYTES, Scratch, utf8

#: Equal payloads of fewer bytes are repeated rather than revisited.
LEAST_BYTES = 100
CRLF = "\r\n"


def hex_id(key: Column) -> Column:
    """A record id from the record's own number: a fixed UUID form, the same at each run."""
    h = F.lpad(F.lower(F.hex(key)), 32, "0")
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))))


def one_line(url: Column) -> Column:
    """A line end inside a URL would end the header field: it is percent-encoded."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, path: str, scratch: Scratch, least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes ``path``/payloads (digest, payload) and ``path``/headers (record, page_id, digest, header).

    ``header`` is the WARC header and, for HTTP, the header block inside the record, to the byte; the payload follows
    it in the record of a response and is absent from a revisit. Of records with equal payloads of at least
    ``least_bytes`` bytes, that with the least page_id (null last; then the least url, then the first row) is the
    response. Null html is the empty payload. Payloads cross one exchange, distinct ones of each task only.
    """
    payload = utf8(pages["html"])
    rows = pages.select(F.monotonically_increasing_id().alias("record"), pages["page_id"].cast("long").alias("page_id"), one_line(pages["url"].cast("string")).alias("url"), F.sha2(payload, 256).alias("digest"), F.length(payload).cast("long").alias("size"), F.xxhash64(payload).alias("check"))
    rows = scratch.save(rows, "records")
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.coalesce("url", F.lit("")).alias("url"), "record")
    groups = rows.groupBy("digest").agg(F.min(order).alias("first"), F.min("check").alias("check"), F.max("check").alias("check2"), F.min("size").alias("size"), F.max("size").alias("size2"))
    same = F.when((F.col("check") == F.col("check2")) & (F.col("size") == F.col("size2")), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("unequal payloads of one digest "), "digest")))
    groups = groups.select(same.alias("digest"), F.col("first.record").alias("first_record"), F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"))
    full = rows.join(groups, "digest")
    revisit = (F.col("size") >= least_bytes) & (F.col("record") != F.col("first_record"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    refers = F.concat(F.lit("WARC-Refers-To: "), hex_id(F.col("first_record")), F.lit(CRLF + "WARC-Refers-To-Page: "), F.coalesce(F.col("first_page").cast("string"), F.lit("")), F.lit(CRLF + "WARC-Refers-To-Target-URI: "), "first_url", F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(CRLF + "WARC-Record-ID: "), hex_id(F.col("record")),
        F.lit(CRLF + "WARC-Date: " + date + CRLF + "WARC-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(CRLF + "WARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit(CRLF + "WARC-Payload-Digest: sha256:"), "digest", F.lit(CRLF),
        F.when(revisit, refers).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string"), F.lit(CRLF + CRLF), http,
    )
    full.select("record", "page_id", "digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    store = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).dropDuplicates(["digest"])
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, its fields parsed from the stored header, its payload's size and digest taken again from the stored bytes.

    A payload that doesn't have its digest ends the query with an error. Payload bytes stay where they are read;
    only sizes and digests are joined to the headers.
    """
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    found = F.sha2("payload", 256)
    checked = F.when(found == F.col("digest"), found).otherwise(F.raise_error(F.concat(F.lit("a payload lacks its digest "), "digest")))
    known = payloads.select("digest", F.length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"))

    def field(name: str) -> Column:
        return F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)\r\n", 1)

    def number(name: str) -> Column:
        return F.when(field(name) != "", field(name).cast("long"))

    parsed = headers.select(
        "record", "header", number("WARC-Page-ID").alias("page_id"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"),
        field("WARC-Type").alias("record_type"), number("WARC-Refers-To-Page").alias("refers_to"), field("WARC-Target-URI").alias("url"),
    )
    return parsed.join(known, "digest")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(record, page_id, bytes): each original record, its header with the stored payload behind it (none behind a revisit) and the two line ends that close it."""
    payloads = spark.read.parquet(f"{path}/payloads")
    headers = spark.read.parquet(f"{path}/headers").withColumn("revisit", F.col("header").startswith("WARC/1.1" + CRLF + "WARC-Type: revisit"))
    close = F.lit((CRLF + CRLF).encode())
    full = headers.where("not revisit").join(payloads, "digest").select("record", "page_id", F.concat(F.col("header").cast("binary"), "payload", close).alias("bytes"))
    return full.unionByName(headers.where("revisit").select("record", "page_id", F.concat(F.col("header").cast("binary"), close).alias("bytes")))


def export(spark: SparkSession, path: str, to: str) -> None:
    """WARC files, one a task, of whole records of UTF-8 payloads."""
    records = reconstruct(spark, path).select(F.col("bytes").cast("string").alias("value"))
    records.select(F.expr("substring(value, 1, length(value) - 4)").alias("value")).write.option("lineSep", CRLF + CRLF).text(to)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a WARC file; a block is as long as its header says."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode("utf-8", "replace").split(CRLF) if stop >= 0 else [""]
        if not version.startswith("WARC/1."):
            raise ValueError(f"no WARC record begins at {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) < size or data[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at {at} is cut off")
        yield fields, block
        at = stop + 8 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, url, payload, payload_digest, refers_to) of the WARC files under ``path``, a task reading whole files (under 2 GB, as :func:`export` writes them).

    The payload of a response stands behind its HTTP header and must have its digest; a revisit has none (null).
    """
    names = ["page_id", "record_type", "url", "payload", "payload_digest", "refers_to"]
    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        for b in batches:
            for content in b.column("content"):
                rows: list[tuple] = []
                held = 0
                for fields, block in parsed(content.as_py()):
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if fields["warc-type"] == "response" else None
                    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"a payload lacks its digest {digest}")
                    rows.append((number(fields["warc-page-id"]), fields["warc-type"], fields["warc-target-uri"], payload, digest, number(fields.get("warc-refers-to-page"))))
                    held += len(block)
                    if held >= ARROW_BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, "page_id long, record_type string, url string, payload binary, payload_digest string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives the pages and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    scratch = Scratch(pages.sparkSession, "warc")
    write_archive(pages, scratch.path("archive"), scratch)
    scratch.drop("records")
    return read_records(pages.sparkSession, scratch.path("archive")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
