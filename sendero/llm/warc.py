"""WARC archives by Spark's own text sink and source, and a chunked record table.

A payload is a table of (record, segment, content) rows of at most ``SEGMENT`` characters; the first
segment is the ``response`` record, more are its ``continuation`` records (WARC record segmentation),
so no task ever builds a whole record of an oversized payload. The sink's line separator is the blank
lines that end a record; the source's is the version line that begins one, which cannot overlap itself. A payload that
holds a version line, or ends in one that the blank lines would complete, is cut within it. Files are gzipped; how many there are follows from the partitions of the write.

Reading checks every block's length and carries a running SHA-1 over a record's segments in order.
Equal payloads are stored once: others are ``revisit`` records that refer to the smallest id.

Nulls: null html is an empty payload, null url an empty target. A null page_id is stored as a response
and never referred to. Rows repeated with the smallest id of a payload are all responses; copies of a
larger id all revisit. Control characters and blanks in urls are percent-encoded in headers.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import in_arrow

VERSION = "WARC/1.1"
CRLF = "\r\n"
END = CRLF + CRLF
BEGIN = VERSION + CRLF
SEGMENT = 1 << 16
PREFIX = "urn:page:"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hex SHA-1: five hex digits are four base32 digits."""

    def four(i: Column) -> Column:
        value = F.conv(F.substring(hex_digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        digits = [F.substring(F.lit(_B32), F.shiftright(value, k).bitwiseAND(31) + 1, F.lit(1)) for k in (15, 10, 5, 0)]
        return F.concat(*digits)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def originals(pages: DataFrame) -> DataFrame:
    """pages plus sha1 (hex) and original: the smallest id with an equal payload, null if never equal."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.withColumns({"sha1": F.sha1(body), "payload_bytes": F.octet_length(body).cast("bigint")})
    first = (
        keyed.filter("page_id IS NOT NULL")
        .groupBy(F.col("sha1").alias("of_sha1"), F.col("payload_bytes").alias("of_bytes"))
        .agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    same = (F.col("sha1") == F.col("of_sha1")) & (F.col("payload_bytes") == F.col("of_bytes"))
    return keyed.join(first, same, "left").drop("of_sha1", "of_bytes")


def segments(html: Column) -> Column:
    """array<string>: the payload in pieces of SEGMENT characters, none of which holds a record's mark."""
    # one pass over the text, whatever its length
    pieces = F.regexp_extract_all(html, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))
    plain = F.when(F.char_length(html) <= SEGMENT, F.array(html)).otherwise(pieces)
    # a version line within a payload is cut in two, so that it is never taken for a record's first line
    cut = F.flatten(F.transform(plain, lambda x: F.split(x, r"(?<=WA)(?=RC/1\.1(?:\r\n|\z))", -1)))
    return F.when(F.instr(html, VERSION) > 0, cut).otherwise(plain)


def records(pages: DataFrame, segment=segments) -> DataFrame:
    """The chunked record table: record id, segment number and count, kind, content and what headers need."""
    rows = originals(pages).select(
        "page_id",
        F.coalesce("url", F.lit("")).alias("url"),
        "payload_bytes",
        base32(F.col("sha1")).alias("digest"),
        F.when(F.col("page_id") > F.col("original"), F.col("original")).alias("refers_to"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.expr("uuid()").alias("uid"),
    )
    parts = F.when(F.col("refers_to").isNotNull(), F.array(F.lit(""))).otherwise(segment(F.col("html")))
    parts = rows.withColumn("parts", parts).drop("html")
    out = parts.withColumn("n_segments", F.size("parts"))
    return out.select("*", F.posexplode_outer("parts").alias("segment", "content")).drop("parts")


def _lines(*pairs) -> Column:
    """Header lines; a pair whose value is null is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in pairs])


def _text(table: DataFrame) -> DataFrame:
    """One string per record: headers, blank line, block."""
    first, split = F.col("segment") == 0, F.col("n_segments") > 1
    record = F.concat(F.lit(f"<{PREFIX}"), F.col("uid"), F.lit(">"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    kind = (
        F.when(F.col("refers_to").isNotNull(), "revisit").when(first, "response").otherwise("continuation")
    )
    head = _lines(
        ("WARC-Type", kind),
        ("WARC-Record-ID", F.when(first, record).otherwise(F.concat(F.lit(f"<{PREFIX}"), F.col("uid"), F.lit("/"), F.col("segment"), F.lit(">")))),
        ("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("X-Payload-Length", F.col("payload_bytes").cast("string")),
        ("X-Page", F.col("page_id").cast("string")),
        ("X-Refers-To-Page", F.col("refers_to").cast("string")),
        ("WARC-Profile", F.when(F.col("refers_to").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Segment-Number", F.when(split, (F.col("segment") + 1).cast("string"))),
        ("WARC-Segment-Origin-ID", F.when(split & ~first, record)),
        ("WARC-Segment-Total-Length", F.when(split & (F.col("segment") + 1 == F.col("n_segments")), F.col("payload_bytes").cast("string"))),
        ("Content-Length", F.octet_length("content").cast("string")),
    )
    return table.select(F.concat(F.lit(BEGIN), head, F.lit(CRLF), F.col("content")).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """A folder of gzipped WARC files with a record per row of ``pages(page_id, url, html)``."""
    _text(records(pages)).write.option("lineSep", END).option("compression", "gzip").text(path)


PARSED = (
    "record string, number int, total bigint, page_id bigint, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, said string, content binary"
)


def _fields(head: bytes) -> dict[bytes, str]:
    pairs = (line.split(b": ", 1) for line in head.split(b"\r\n") if b": " in line)
    return {name: value.decode() for name, value in pairs}


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _parse(batches):
    """Records as the source cuts them: fields, and the content of segments only."""
    end = END.encode()
    for batch in batches:
        out = []
        for value in batch.column("value").cast(pa.binary()):
            data = value.as_py()
            if not data:  # what comes before a file's first record
                continue
            middle = data.index(end)
            head, content = _fields(data[:middle]), data[middle + len(end) :]
            size = int(head[b"Content-Length"])
            content, closing = content[:size], content[size:]
            if len(content) != size or closing != end:
                raise ValueError(f"WARC block of wrong length in {head[b'WARC-Record-ID']}")
            kind, said = head[b"WARC-Type"], head[b"WARC-Payload-Digest"].removeprefix("sha1:")
            number = head.get(b"WARC-Segment-Number")
            part = number is not None
            whole = None if part else said if kind == "revisit" else _sha1(content)
            page, refers, total = (head.get(k) for k in (b"X-Page", b"X-Refers-To-Page", b"WARC-Segment-Total-Length"))
            out.append(
                (
                    head.get(b"WARC-Segment-Origin-ID") or head[b"WARC-Record-ID"],
                    int(number) if part else None,
                    int(total) if total else None,
                    int(page) if page else None,
                    "revisit" if kind == "revisit" else "response",
                    int(refers) if refers else None,
                    int(head[b"X-Payload-Length"]) if kind == "revisit" else size,
                    whole,
                    said,
                    content if part else None,
                )
            )
        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
        fields = [x.split() for x in PARSED.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], kinds[kind]) for k, (_, kind) in enumerate(fields)], [n for n, _ in fields]
        )


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _join_segments(batches):
    """Rows sorted by record and segment to one row per record; segments feed a running SHA-1."""
    open_row, sha, size, number, total = None, None, 0, 0, None

    def close():
        digest = base64.b32encode(sha.digest()).decode()
        if size != total or digest != open_row[3]:
            raise ValueError(f"WARC segments missing or changed in {open_row[0]}")
        return open_row[1], size, digest, open_row[2], None

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [x.split()[0] for x in READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if open_row and r["record"] != open_row[0]:
                out.append(close())
                open_row = None
            if r["number"] is None:
                if r["payload_digest"] != r["said"]:
                    raise ValueError(f"WARC payload digest differs in {r['record']}")
                out.append(tuple(r[x.split()[0]] for x in READ.split(", ")))
                continue
            if open_row is None:
                open_row = (r["record"], r["page_id"], r["record_type"], r["said"])
                sha, size, number, total = hashlib.sha1(), 0, 0, None
            number += 1
            if r["number"] != number:
                raise ValueError(f"WARC segment {number} of {r['record']} is missing")
            sha.update(r["content"])
            size += len(r["content"])
            total = r["total"] if r["total"] is not None else total
        yield batch_of(out)
    if open_row:
        yield batch_of([close()])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the archives.

    Raises if a block is not as long as its header says, a payload not what its digest says, or a
    segment is missing. Only segments carry their content through the shuffle that joins them.
    """
    raw = spark.read.option("lineSep", BEGIN).text(path)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parsed = in_arrow(raw, _parse, PARSED).repartition(ranges, "record").sortWithinPartitions("record", "number")
    return in_arrow(parsed, _join_segments, READ)
