"""A content-addressed archive of WARC records.

Each page is one record of WARC 1.1. The archive has two tables. ``payloads`` has the bytes of each distinct payload once, by their SHA-256.
``headers`` has the exact bytes of each record before its payload (fields of the record, then the HTTP headers) with the digest of the payload.
A join by the digest gives the records back, byte for byte: of records with equal payloads the one with the largest page_id is the response, and the others
are revisits that refer to it and end with their HTTP headers. Payloads that occur several times are compared by their bytes as they are drawn together, so equal digests
are known to be equal bytes; whatever is read is hashed again.

Unique payloads go to the table without a shuffle; copies are drawn together within their tasks first. The digests of copies are broadcast if their
number is small, and joined otherwise. Records can also be written as WARC files, and such files read back by their lengths.

Null html is an empty payload, which is like any other. Repeated page_ids with equal payloads: one row of the largest is the response (of the greatest url, then the last place), and the rest refer to
it. A null page_id counts as less than all others. A null url leaves out its field; line ends in one are percent-encoded. Payloads may be of any length that Spark
can hold in a value. Other columns aren't read, so their names can't clash. No rows: two empty tables.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, shared_dir

DATE = "2026-01-01T00:00:00Z"
#: Payloads smaller than this are never revisited.
LEAST_BYTES = 0
#: Digests of copies are broadcast up to this number (some 100 bytes each).
BROADCAST_COPIES = 100_000
RECORDS_PER_FILE = 2_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def archive_path(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/archives/{uuid.uuid4().hex}"


def base32(hexadecimal: Column) -> Column:
    """Base32 of 40 hexadecimal digits: four letters for each five digits."""
    groups = [F.lpad(F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def _digest(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def _record_id(page_id: Column, place: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), place.cast("string"), F.lit(">"))


def headers_of(keys: DataFrame, copies: DataFrame, few: bool) -> DataFrame:
    """header and digest of each record; keys: page_id, url, place, digest, sha1, n_bytes; copies: digest and its response, where there are several."""
    got = keys.join(F.broadcast(copies) if few else copies, "digest", "left")
    first = F.coalesce((F.col("place") == F.col("response.place")) | (F.col("n_bytes") < LEAST_BYTES), F.lit(True))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = [
        F.lit("WARC/1.1"),
        F.when(first, "WARC-Type: response").otherwise("WARC-Type: revisit"),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("place"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(~first, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(~first, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("response.page_id"), F.col("response.place")))),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(first, F.col("n_bytes")).otherwise(0)).cast("string")),
    ]
    return got.select(F.concat(F.concat_ws(_END, *fields), F.lit(_END + _END), http).alias("header"), "digest")


def write_archive(pages: DataFrame, path: str) -> str:
    """Write headers and payloads of all pages (page_id, url, html) below a new folder; returns it."""
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), _payload(F.col("html")).alias("payload"))
    keys = cut(raw.select("page_id", "url", F.monotonically_increasing_id().alias("place"), _digest(F.col("payload")).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes")))
    response = F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "url", "place")
    groups = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(response).alias("response"))
    copies = cut(groups.filter("n > 1").select("digest", F.struct("response.page_id", "response.place").alias("response")))
    few = copies.count() <= BROADCAST_COPIES
    headers_of(keys, copies, few).write.parquet(f"{path}/headers")
    named, which = raw.select("payload", _digest(F.col("payload")).alias("digest")), copies.select("digest")
    which = F.broadcast(which) if few else which
    once = named.join(which, "digest", "left_anti").select("digest", "payload")
    drawn = named.join(which, "digest", "left_semi").groupBy("digest").agg(F.min("payload").alias("payload"), F.max("payload").alias("other"))
    same = F.when(F.col("payload") == F.col("other"), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads have one digest")))
    once.unionByName(drawn.select("digest", same.alias("payload"))).write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """record (its exact bytes) and payload (the full one, also for revisits) of every record; payloads are checked by their digests."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    got = headers.join(payloads, "digest")
    checked = F.when(_digest(F.col("payload")) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload doesn't have its digest")).cast("binary"))
    revisit = F.col("header").startswith(F.lit("WARC/1.1\r\nWARC-Type: revisit\r\n"))
    head = F.encode("header", "UTF-8")
    record = F.when(revisit, F.concat(head, F.encode(F.lit(_END + _END), "UTF-8"))).otherwise(F.concat(head, F.col("payload"), F.encode(F.lit(_END + _END), "UTF-8")))
    return got.select("header", checked.alias("payload")).select(record.alias("record"), "payload")


def field(head: Column, name: str) -> Column:
    """The value of a field of a record's head; null where it has none."""
    return F.nullif(F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))


def digest_rows(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as the fields of each record say them; lengths and digests are those of the payload itself."""
    head = F.substring_index(F.decode("record", "UTF-8"), "\r\n\r\n", 1)
    got = records.select(head.alias("head"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    page = lambda name: F.nullif(F.regexp_extract(field(F.col("head"), name), "<urn:page:([^:]*):", 1), F.lit("")).cast("long")
    said = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    digest = F.when(field(F.col("head"), "WARC-Payload-Digest") == said, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's payload digest isn't that of its payload")))
    return got.select(page("WARC-Record-ID").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), field(F.col("head"), "WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"))


def write_files(records: DataFrame, path: str) -> None:
    """The records as WARC files, compressed; any file system that Spark writes to."""
    whole = F.decode(F.substring(F.col("record"), F.lit(1), F.octet_length("record") - 4), "UTF-8")
    records.select(whole.alias("value")).write.option("lineSep", _END + _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def split_records(data: bytes) -> Iterator[bytes]:
    """The records of a WARC file, each with what ends it, by their lengths."""
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        fields = dict(line.split(b": ", 1) for line in data[at : body - 4].split(b"\r\n")[1:])
        end = body + int(fields[b"Content-Length"]) + 4
        if data[end - 4 : end] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end where its length says")
        yield data[at:end]
        at = end


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """record: every record of the WARC files in a folder, plain or compressed."""
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content").to_pylist():
                plain, left = b"", data
                while left[:2] == b"\x1f\x8b":
                    member = zlib.decompressobj(31)
                    plain += member.decompress(left) + member.flush()
                    left = member.unused_data
                for r in split_records(plain or data):
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.binary())], ["record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record binary")
