"""WARC archives: writing, and reading with reassembly of segmented records.

A record's block is an HTTP response whose body has chunked transfer framing.
Blocks above a segment size are split: the first part stays in the record, the
others follow as ``continuation`` records that name the first by its id.  The
reader groups those by origin, orders them by segment number, verifies the
total length and decodes the framing.

Archives are gzip files written by Spark's text writer, whose line separator
here is the blank lines that end each WARC record; so they reach any store
that Spark reaches, and a lost task's files are never seen.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netfabric.functions.skew import with_rank
from netfabric.session import cut_lineage, shared_path

VERSION = b"WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PREFIX = "urn:x-page:"
NO_ID = "null"
GZIP, PIECE = b"\x1f\x8b", 1 << 16
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
HTTP_BARE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK = 4096
SEGMENT_BYTES = 8192
RECORDS_PER_FILE = 2000
RECORD_TYPE = (
    "record_id string, type string, segment int, origin string, total_length long, refers_to string, digest string, block binary, error string")


def digest_of(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def split_block(block: bytes, size: int) -> list[bytes]:
    """Parts of about ``size`` bytes, cut between characters, as the text writer stores UTF-8."""
    parts, at = [], 0
    while at < len(block):
        end = min(len(block), at + size)
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end += 1
        parts.append(block[at:end])
        at = end
    return parts or [b""]


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing: hexadecimal length, CRLF, data, CRLF; a chunk of 0 ends it."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in split_block(payload, size) if p]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload; chunk extensions and trailers are skipped.  ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size is missing")
        n = int(body[at:line].split(b";")[0], 16)
        if n < 0:
            raise ValueError("chunk size is negative")
        at = line + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        parts.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP message, without its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(
        line.split(b":", 1)[0].strip().lower() == b"transfer-encoding" and b"chunked" in line.lower() for line in head.split(b"\r\n")[1:])
    return dechunked(body) if framed else body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"Content-Length: %d" % len(block)])
    return head + b"\r\n\r\n" + block


def records_of(name: str, url: str, payload: bytes, digest: str, first: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a response, in segments if it is long, or a revisit of the record named ``first``."""
    own = f"<{PREFIX}{name}>"
    common = [("WARC-Target-URI", url), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    if first is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", f"<{PREFIX}{first}>"),
                      ("WARC-Profile", PROFILE), *common], HTTP_BARE)
        return
    block = HTTP_HEAD + chunked(payload)
    parts = split_block(block, segment_bytes)
    number = [("WARC-Segment-Number", "1")] if len(parts) > 1 else []
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *number, *common], parts[0])
    for i, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{PREFIX}{name}:{i}>"), ("WARC-Segment-Origin-ID", own),
                      ("WARC-Segment-Number", str(i)), *last, ("WARC-Target-URI", url), ("WARC-Date", "1970-01-01T00:00:00Z")], part)


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0,
    segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE, null_ids: bool = False,
) -> None:
    """Write one WARC record per row of ``pages`` to gzip archives under ``path``.

    The payload is the HTML in UTF-8, a null one is empty.  Of the rows with equal
    payloads of at least ``min_revisit`` bytes the smallest id is stored and the
    others revisit it.  Line breaks in a URL become blanks, a null URL is empty.
    Rows that repeat an id have a record each: the first is named by the id, the
    others by the id and a number, and rows that repeat the smallest id of a payload
    are responses all.  Rows with a null id are left out, or with ``null_ids`` written
    under the name ``null``: they revisit a row with an id, else they are responses.
    """
    rows = pages if null_ids else pages.filter(F.col(id_col).isNotNull())
    rows = rows.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\r\n]+", " ").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({
        "size": F.length("payload"), "sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256),
        "name": F.coalesce(F.col("page_id").cast("string"), F.lit(NO_ID))})
    # Only a table with repeated ids needs numbers.
    if rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1):
        rows = cut_lineage(with_rank(rows, ["name"], ["size", "sha1", "sha256", "url"], "_k"))
        rows = rows.withColumn("name", F.when(F.col("_k") == 1, F.col("name")).otherwise(F.concat_ws(".", "name", "_k"))).drop("_k")
    alike = ["size", "sha1", "sha256"]
    smallest = F.struct(F.col("page_id").isNull().alias("null"), "page_id", "name")
    firsts = rows.groupBy(*alike).agg(F.min(smallest).alias("first"))
    placed = rows.join(firsts, alike).withColumn("first", F.when(
        (F.col("size") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first.name")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("name", "url", "payload", "sha1", "first")]
            made = []
            for name, url, payload, sha1, first in zip(*columns, strict=True):
                digest = b32encode(bytes.fromhex(sha1)).decode()
                made.append(END.encode().join(records_of(name, url, payload, digest, first, segment_bytes)))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()).cast(pa.string())], ["value"])

    lines = placed.select("name", "url", "payload", "sha1", "first").mapInArrow(run, "value string")
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def inflate(raw: bytes) -> tuple[bytes, str | None]:
    """All that can be read of an archive, gzip members one after another, and what is wrong with the rest."""
    if raw[:2] != GZIP:
        return raw, None
    parts, view, at = [], memoryview(raw), 0
    while view[at : at + 2] == GZIP:
        member = zlib.decompressobj(31)
        # In pieces, so that what comes before damage is kept.
        while not member.eof and at < len(raw):
            piece = view[at : at + PIECE]
            try:
                parts.append(member.decompress(piece))
            except zlib.error:
                return b"".join(parts), "archive is damaged"
            at += len(piece) - len(member.unused_data)
        if not member.eof:
            return b"".join(parts), "archive is cut off"
    return b"".join(parts), "archive is damaged" if raw[at:].strip(b"\0") else None


def parse(archive: bytes) -> Iterator[dict]:
    """The records of one archive, by their content lengths.

    A record whose header is cut off, or lacks a length, type or id, or has a bad number,
    gives ``error`` and an empty block; reading goes on at the next record that follows blank lines.
    """
    at = archive.find(VERSION[:5])
    while at >= 0:
        head_end = archive.find(b"\r\n\r\n", at)
        fields = {}
        for line in archive[at : head_end if head_end >= 0 else len(archive)].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode(errors="replace")] = value.strip().decode(errors="replace")
        numbers = [fields.get("content-length", ""), fields.get("warc-segment-number", "0"), fields.get("warc-segment-total-length") or "0"]
        wrong = "header is cut off" if head_end < 0 else "length is missing" if not numbers[0] else "number is bad" if not all(
            x.isascii() and x.isdigit() and len(x) < 19 for x in numbers) else "id or type is missing" if not (
            fields.get("warc-record-id") and fields.get("warc-type")) else None
        start = head_end + 4
        end = start + int(numbers[0]) if head_end >= 0 and wrong in (None, "id or type is missing") else None
        if wrong is None and end > len(archive):
            wrong = "block is cut off"
        yield fields | {"block": archive[start:end] if wrong is None else b"", "error": wrong}
        if end is not None and wrong != "block is cut off":
            at = archive.find(VERSION[:5], end)
        else:
            after = archive.find(END.encode() + VERSION[:5], at)
            at = after + len(END) if after >= 0 else -1


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``RECORD_TYPE`` rows of all archives under ``path``, one archive at a time in a task.

    A record that cannot be read is a row with an ``error``; an archive that is damaged or
    cut off gives the records before that and one more row with an error.
    """

    def row(f: dict) -> dict:
        bad = f["error"] is not None
        own, total = f.get("warc-record-id", "").strip("<>"), f.get("warc-segment-total-length")
        return {
            "record_id": own or None, "type": f.get("warc-type"), "segment": 0 if bad else int(f.get("warc-segment-number", 0)),
            "origin": f.get("warc-segment-origin-id", own).strip("<>") or None, "total_length": int(total) if total and not bad else None,
            "refers_to": f.get("warc-refers-to", "").strip("<>") or None,
            "digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None, "block": f["block"], "error": f["error"]}

    def rows(raw: bytes) -> Iterator[dict]:
        archive, wrong = inflate(raw)
        for f in parse(archive):
            yield row(f)
        if wrong:
            yield row({"block": b"", "error": wrong})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                out = []
                for r in rows(content.as_py()):
                    out.append(r)
                    if len(out) == 256:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("segment", pa.int32()), ("origin", pa.string()),
                        ("total_length", pa.int64()), ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary()),
                        ("error", pa.string())])
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORD_TYPE)


def join_segments(segments: list[tuple[int, bytes]], total: int | None) -> tuple[bytes | None, str | None]:
    """``(block, error)`` of the segments of one record, in any order; one may come twice."""
    parts = dict(segments)
    if sorted(parts) != list(range(1, len(parts) + 1)):
        return None, "segment is missing"
    block = b"".join(parts[i] for i in sorted(parts))
    if total is None or total != len(block):
        return None, "total length differs"
    return block, None


def reassemble(records: DataFrame) -> DataFrame:
    """``(record_id, type, refers_to, digest, payload, error)``: whole records with decoded payloads.

    Only segmented records are grouped, by the id of their origin.  Where a segment
    is missing, the total length differs or the framing is broken, ``payload`` is
    null and ``error`` says so; a payload whose digest differs from the header's is
    kept with an error.  A record that could not be read keeps its error.
    """
    whole = records.filter("segment = 0").select("record_id", "type", "refers_to", "digest", F.array(
        F.struct(F.col("segment"), F.col("block"))).alias("parts"), "total_length", "error")
    grouped = records.filter("segment > 0").groupBy(F.col("origin").alias("record_id")).agg(
        F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"), F.max("refers_to").alias("refers_to"),
        F.max("digest").alias("digest"), F.collect_list(F.struct("segment", "block")).alias("parts"), F.max("total_length").alias("total_length"),
        F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                segments = [(p["segment"], p["block"]) for p in r["parts"]]
                if r["error"]:
                    block, error = None, r["error"]
                else:
                    block, error = (segments[0][1], None) if segments[0][0] == 0 else join_segments(segments, r["total_length"])
                payload = None
                if block is not None:
                    try:
                        payload = payload_of(block)
                    except ValueError as broken:
                        error = str(broken)
                if payload is not None and r["type"] != "revisit" and r["digest"] and r["digest"] != digest_of(payload):
                    error = "digest differs"
                out.append({c: r[c] for c in ("record_id", "type", "refers_to", "digest")} | {"payload": payload, "error": error})
                if len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()),
                        ("payload", pa.binary()), ("error", pa.string())])
    return whole.unionByName(grouped).mapInArrow(
        run, "record_id string, type string, refers_to string, digest string, payload binary, error string")


def page_of(column: str):
    """The page id in a record's name: what stands before a repeat's number; null if there is none."""
    return F.split_part(F.substring(F.col(column), len(PREFIX) + 1, 60), F.lit("."), F.lit(1)).try_cast("long")


def resolve(payloads: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, error)`` of each response and revisit.

    A revisit has the length and digest of the payload that it refers to, or an error if that is not there.
    Records that could not be read come along with their error.
    """
    # Written once: responses and revisits would each read all archives again.
    read = cut_lineage(payloads.select(
        "record_id", F.col("type").alias("record_type"), F.col("refers_to").alias("_name"),
        F.length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "error"))
    kind = F.coalesce("record_type", F.lit(""))
    responses = read.filter(kind == "response")
    unread = read.filter(F.col("error").isNotNull() & ~kind.isin("response", "revisit"))
    stored = responses.select(F.col("record_id").alias("_name"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    revisits = read.filter(kind == "revisit").join(stored, "_name", "left")
    wrong = F.when(F.col("_digest").isNull(), "original is missing").when(F.col("_digest") != F.col("payload_digest"), "digest differs")
    page, nothing = page_of("record_id").alias("page_id"), F.lit(None).cast("long").alias("refers_to")
    names = [page, "payload_bytes", "payload_digest", "record_type", nothing, "error"]
    return responses.select(*names).unionByName(unread.select(*names)).unionByName(revisits.select(
        page, F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", page_of("_name").alias("refers_to"),
        F.coalesce(wrong, "error").alias("error")))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives beside the checkpoints, which all executors share."""
    return shared_path(spark, "warc")


WARC_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(sha1(p.html), 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> p.page_id THEN first END AS refers_to
FROM p JOIN f ON p.html = f.html
"""
