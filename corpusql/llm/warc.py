"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing. Of pages with equal payloads the one with the largest page_id is the response and the others revisit it. A
record is one row of text and the writer's line separator is the blank line that ends a record, so the files in the
shared folder are WARC 1.0 under gzip, a bounded number of records each.

Reading. A file's bytes are searched for the version line, which payloads may hold too. Every place found is a candidate
whose header names its successor's offset. Starting from offset 0, pointer jumping over (file, offset, successor) marks
what can be reached; each round doubles the jumps, so a chain of n records takes log2(n) rounds of two joins. Only
reached candidates are records.

Null html: empty payload. Null page_id: kept null, a revisit of the group's largest. Rows that repeat a group's largest
page_id are all responses. Extra columns are ignored; white space in a URL is percent-encoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import cut, shared_path, table

RECORDS_IN_FILE, SALTS = 1000, 16
VERSION = b"WARC/1.0\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string: five hex digits are four of base32."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame) -> DataFrame:
    """page_id, payload_digest, payload_bytes, record_type, refers_to and record: its header and payload as text."""
    payload = F.coalesce("html", F.lit(""))
    made = pages.select("page_id", "url", payload.alias("payload"))
    made = made.withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long"), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
    groups = made.groupBy("payload_digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    made = made.join(salted, ["payload_digest", "salt"], "left")
    again = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    made = made.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("response_id")))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]+", "%0D%0A"), "[ \t]", "%20")
    lines = [
        F.lit(VERSION.decode().strip()),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.concat(F.lit("X-Payload-Bytes: "), F.col("payload_bytes").cast("string")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.when(again, "0").otherwise(F.col("payload_bytes").cast("string"))),
    ]
    header = F.concat_ws("\r\n", *lines)
    return made.select("page_id", "payload_digest", "payload_bytes", "record_type", "refers_to", F.concat(header, F.lit("\r\n\r\n"), F.when(again, "").otherwise(F.col("payload"))).alias("record"))


def write_warc(pages: DataFrame, path: str, records_in_file: int = RECORDS_IN_FILE) -> None:
    records(pages).select("record").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_in_file).text(path, compression="gzip")


_FIELD = re.compile(rb"([A-Za-z-]+): *([^\r\n]*)")
_SCHEMA = "file string, at bigint, next bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _candidate(content: memoryview, raw: bytes, at: int) -> tuple | None:
    """What the header at an offset says, if it is one: its successor's offset and the record's fields."""
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = dict(_FIELD.findall(raw[at + len(VERSION) : end]))
    if not fields.get(b"Content-Length", b"").isdigit():
        return None
    begin = end + 4
    stop = begin + int(fields[b"Content-Length"])
    if raw[stop : stop + 4] != b"\r\n\r\n":
        return None
    page = fields.get(b"WARC-Record-ID", b"")[len(b"<urn:page:") : -1]
    to = fields.get(b"WARC-Refers-To", b"")[len(b"<urn:page:") : -1]
    kind = fields.get(b"WARC-Type", b"").decode("latin-1")
    if kind == "revisit":
        size, digest = int(fields.get(b"X-Payload-Bytes", b"0") or 0), fields.get(b"WARC-Payload-Digest", b"").partition(b":")[2].decode("latin-1")
    else:
        size, digest = stop - begin, base64.b32encode(hashlib.sha1(content[begin:stop]).digest()).decode()
    number = lambda x: int(x) if x.lstrip(b"-").isdigit() else None
    return stop + 4, number(page), size, digest, kind, number(to)


def candidates(files: DataFrame) -> DataFrame:
    """From a binaryFile read: every place that looks like a record, with its successor's offset."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string() if n in ("file", "payload_digest", "record_type") else pa.int64()) for n in (x.split()[0] for x in _SCHEMA.split(", "))])
        for batch in batches:
            for i in range(batch.num_rows):
                name, raw, rows, at = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), [], 0
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                while (at := raw.find(VERSION, at)) >= 0:
                    if found := _candidate(memoryview(raw), raw, at):
                        rows.append((name, at, *found))
                    at += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(each, _SCHEMA)


def reachable(links: DataFrame) -> DataFrame:
    """Of (file, at, next), the (file, at) that the chain from offset 0 of their file reaches."""
    longest = links.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    state = cut(links.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("reached")))
    for _ in range(max(0, longest - 1).bit_length()):
        far = state.select("file", F.col("at").alias("jump"), F.col("jump").alias("far"))
        hit = state.where("reached").select("file", F.col("jump").alias("at"), F.lit(True).alias("hit")).distinct()
        state = state.join(far, ["file", "jump"], "left").join(hit, ["file", "at"], "left")
        state = cut(state.select("file", "at", F.col("far").alias("jump"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")))
    return state.where("reached").select("file", "at")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record under a path."""
    found = cut(candidates(spark.read.format("binaryFile").load(path)))
    true = reachable(found.select("file", "at", "next"))
    return found.join(true, ["file", "at"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path)


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hx, max(page_id) OVER (PARTITION BY sha1(html)) AS top FROM p)
SELECT page_id, payload_bytes,
       translate({parts}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM h
""".format(parts=" || ".join(f"upper(to_base(('0x' || substr(hx, {1 + 5 * k}, 5))::BIGINT, 32, 4))" for k in range(8)))
