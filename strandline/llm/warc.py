"""WARC archives with repeated payloads resolved to revisit records.

Headers (key, digest, length) are shuffled by payload digest; the record with the largest key of each
digest is the response, the others revisit it. Only then do payloads move: the writer puts each response's
payload into an archive once, and a revisit gets a header alone. Archives are WARC files under gzip that
Spark's text writer makes (its line separator is the last byte of a record's end), so they may lie in any
store and a lost task leaves no half file. `read_archives` parses whole files by Content-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_saved, save, scratch_dir

# The alphabet of RFC 4648 base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, page_id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to_id string, payload binary"


def base32(hex_digits: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex, without Python: 10 hex digits at a time are 8 digits to base 32."""
    groups = [F.lpad(F.conv(F.substring(hex_digits, 10 * part + 1, 10), 16, 32), 8, "0") for part in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """headers: page_id, payload_digest, payload_bytes. Adds record_type and refers_to.

    Equal payloads of at least `min_bytes` have one response, the largest page_id; smaller ones are all
    responses. Rows that repeat that page_id too are responses as well, as they would refer to
    themselves; so is a row without page_id when no equal payload has one.
    """
    large = headers.where(F.col("payload_bytes") >= min_bytes)
    uri = "uri" if "uri" in headers.columns else F.lit(None).cast("string")
    first = large.where("page_id IS NOT NULL").groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("response"), F.max_by(uri, "page_id").alias("response_uri"))
    out = headers.join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("response").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("response")))
    return out.select(*headers.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"), F.when(revisit, F.col("response_uri")).alias("refers_to_uri"))


def _record_id(page: Column, digest: Column) -> Column:
    """A stable URN made from page and payload, in the form of a UUID."""
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), *[F.concat(F.substring(h, a, n), F.lit(end)) for a, n, end in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">"))])


def write_archives(pages: DataFrame, path: str, payload: str = "html", key: str = "page_id", uri: str = "url", min_bytes: int = 0, file_bytes: int = 4_000_000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row, in archives of about `file_bytes`; a null payload is empty, a null uri an empty one. A response's block is an
    HTTP response whose body is the payload; the digest is the payload's."""
    clean = F.regexp_replace(F.coalesce(F.col(uri), F.lit("")), r"[\r\n]", " ")
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), clean.alias("uri"), body.alias("body"))
    # Joined by the hex digits: base32 can be null to Spark, which would then filter by it, with a SHA-1 for each of its parts.
    keyed = rows.withColumns({"sha": F.sha1("body"), "payload_bytes": F.octet_length("body").cast("long")})
    sums = save(keyed.select("page_id", "uri", F.col("sha").alias("payload_digest"), "payload_bytes"))
    resolved = resolve_revisits(sums, min_bytes).withColumnRenamed("payload_digest", "sha")
    headers = save(resolved.withColumn("payload_digest", base32(F.col("sha"))))
    drop_saved(sums)
    revisit = headers.where("record_type = 'revisit'")
    mean = headers.agg(F.avg("payload_bytes")).first()[0] or 0
    records = max(1, int(file_bytes // (mean + 500)))

    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page_line = F.when(F.col("page_id").isNull(), F.lit("")).otherwise(line("X-Page-Id", F.col("page_id").cast("string")))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))

    def record(kind: str, length: Column, extra: Column, block: Column) -> Column:
        return F.concat(
            F.lit("WARC/1.1\r\n"), line("WARC-Type", F.lit(kind)), line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))), line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", F.col("uri")), page_line, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), extra,
            line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit("\r\n"), block, F.lit("\r\n\r"),
        )

    # A response is known without its payload's neighbours: its page is the largest of its digest.
    whole = headers.where("record_type = 'response'").select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "payload_digest").distinct()
    responses = keyed.join(whole, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")))
    full = responses.select(record("response", F.length(http) + F.col("payload_bytes"), F.lit(""), F.concat(http, F.col("body"))).alias("value"))
    refers = F.concat(line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest"))), line("WARC-Refers-To-Target-URI", F.coalesce("refers_to_uri", F.lit(""))), line("WARC-Refers-To-Date", F.lit(date)), line("WARC-Profile", F.lit(REVISIT_PROFILE)))
    bare = revisit.select(record("revisit", F.lit(0), refers, F.lit("")).alias("value"))
    writer = full.unionByName(bare).write.option("lineSep", "\n").option("maxRecordsPerFile", records)
    writer.option("compression", "gzip").text(path)


def parse(content: bytes, with_payload: bool = True) -> Iterator[tuple]:
    """Records of one archive, by their Content-Length; a payload that does not give its digest is an error."""
    view = memoryview(content)
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        block = view[end + 4 : end + 4 + n]
        if content[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end")
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = head["WARC-Type"]
        if kind == "response":  # the payload follows the HTTP header
            block = block[content.index(b"\r\n\r\n", end + 4, end + 4 + n) + 4 - (end + 4) :]
        if kind == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
            raise ValueError(f"wrong digest at byte {at}")
        page = head.get("X-Page-Id")
        yield (head["WARC-Record-ID"], None if page is None else int(page), head["WARC-Target-URI"], kind, digest, len(block) if kind == "response" else None, head.get("WARC-Refers-To"), bytes(block) if with_payload and kind == "response" else None)
        at = end + 8 + n


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """All records of the archives in `path`. Files are whole rows here; write_archives bounds them."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                out = pd.DataFrame(list(parse(gzip.decompress(content), with_payload)), columns=names)
                out[["page_id", "payload_bytes"]] = out[["page_id", "payload_bytes"]].astype("Int64")
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return save(files.mapInPandas(run, RECORD), 1)


def joined_records(records: DataFrame) -> DataFrame:
    """Revisit records joined to their responses: each row has the full payload's length and its page."""
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes")).distinct()
    out = records.join(responses, "refers_to_id", "left")
    return out.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("_page")).alias("refers_to"), "uri")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write archives of `pages` below the shared folder and read them back: a row a page, rows that repeat and null ids too. A null or empty
    payload has 0 bytes; very long ones are one record; columns besides those named are not looked at; an empty table gives no row."""
    spark = pages.sparkSession
    path = scratch_dir(spark)
    write_archives(pages, path, **options)
    return joined_records(read_archives(spark, path))
