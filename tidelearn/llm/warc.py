"""WARC archives: records written through Spark's text sink, read back by a salvage reader.

Writing: equal payloads are found by digest; the record of the largest id is the
response, the others revisit it.  A record is one row of text, and the sink's row
separator is the format's record end, so executors write valid archives to any store
Spark writes to.

Reading: each archive is cut into records by their headers.  A record must state its
length, end where it says and hold the payload its digest names.  After a failed check the
reader looks for the next version line (or the next valid gzip member), goes on from there
and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelearn.llm.registry import register, table
from tidelearn.session import materialize, new_path

#: Records in one archive and their bytes, at most; a longer record makes an archive of its own.
RECORDS, ARCHIVE_BYTES = 2000, 64 << 20
#: Records with equal payloads of at least so many bytes are revisits of one of them.
LEAST_BYTES = 0
RECORD_END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four base32 letters."""
    digest = F.sha1(payload)
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def with_revisits(records: DataFrame, least: int = LEAST_BYTES) -> tuple[DataFrame, int]:
    """``records`` (id, url, payload) with bytes, digest and refers_to: the id of the response that a revisit stands for.
    Also the bytes of the longest payload.

    Only ids and digests are shuffled.  Those that revisit are a table of their own, so payloads move only if it is large.
    """
    told = records.withColumn("bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", base32_sha1(F.col("payload")))
    every = materialize(told.select("id", "digest", "bytes"), "warc-digests")
    longest = every.agg(F.max("bytes")).first()[0] or 0
    keys = every.where(F.col("bytes") >= least)
    first = keys.groupBy("digest", "bytes").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1")
    revisits = keys.join(first, ["digest", "bytes"]).where("id < response").select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), F.col("response").alias("refers_to"))
    revisits = materialize(revisits.distinct(), "warc-revisits")
    return told.join(revisits, (F.col("id") == F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left").drop("rid", "rdigest"), longest


def record_text(date: str) -> Column:
    """The record of a row of ``with_revisits``, without the record end."""
    line = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))
    # Line ends in a url would end its header line.
    url = F.coalesce(F.regexp_replace("url", r"[\r\n]", "%0A"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("bytes").cast("string"), F.lit(line * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    header = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{line}WARC-Record-ID: "), name, F.lit(f"{line}WARC-Date: {date}{line}WARC-Target-URI: "), url,
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(f"{line}WARC-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(
            F.lit(f"{line}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: <urn:page:"),
            F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{line}Content-Type: application/http;msgtype=response{line}Content-Length: "), F.octet_length(block).cast("string"), F.lit(line * 2),
    )
    return F.concat(header, block)


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES,
    date: str = "2024-01-01T00:00:00Z", compression: str = "none",
) -> None:
    """Write a WARC record per row under ``path``, to archives of at most ``RECORDS`` records and about ``ARCHIVE_BYTES``.

    A null payload is written as an empty one, a null url as an empty one, a null id as an empty name.
    Of repeated rows with the largest id all are responses; rows with a null id are always responses.
    An empty table makes archives without records.  Other columns are not read.
    """
    records = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    told, longest = with_revisits(records, least)
    each = max(1, min(RECORDS, ARCHIVE_BYTES // (longest + 1024)))
    told.select(record_text(date)).write.option("lineSep", RECORD_END).option("compression", compression).option("maxRecordsPerFile", each).text(path)


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"


#: Bytes given to the decompressor at a time; what it reads beyond a member is no more than that.
_BLOCK = 1 << 14


def _member(data: memoryview, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member that begins at ``at``, None if it is damaged or cut off."""
    unzip, parts, k = zlib.decompressobj(31), [], at
    try:
        while not unzip.eof and k < len(data):
            parts.append(unzip.decompress(data[k : k + _BLOCK]))
            k = min(k + _BLOCK, len(data))
    except zlib.error:
        return None
    return (b"".join(parts), k - len(unzip.unused_data)) if unzip.eof else None


def members(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes | None, int]]:
    """(offset, content, end) of each gzip member from ``at`` on; content None for a gap up to the next valid member."""
    view, bad = memoryview(data), None
    while at < len(data):
        got = _member(view, at) if data.startswith(_MEMBER, at) else None
        if got:
            if bad is not None:
                yield bad, None, at
                bad = None
            yield at, *got
            at = got[1]
        else:
            bad = at if bad is None else bad
            after = data.find(_MEMBER, at + 1)
            at = after if after >= 0 else len(data)
    if bad is not None:
        yield bad, None, len(data)


_DIGEST_BYTES = {"md5": 16, "sha1": 20, "sha224": 28, "sha256": 32, "sha384": 48, "sha512": 64}


def _agrees(stated: str, payload: bytes) -> bool | None:
    """Whether a stated digest, in hexadecimal or base32 of either case, is the payload's; None if there is none or its algorithm is unknown."""
    name, colon, value = stated.rpartition(":")
    name = name.lower().replace("-", "") if colon else "sha1"
    if not value or name not in _DIGEST_BYTES:
        return None
    own = hashlib.new(name, payload, usedforsecurity=False).digest()
    if len(value) == 2 * len(own):
        return value.lower() == own.hex()
    return value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _record(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record that begins at ``at`` and where it ends, or what is wrong with it."""
    line = _VERSION.match(data, at)
    if not line:
        return "no version line"
    head = data.find(b"\r\n\r\n", line.end() - 2)
    if head < 0:
        return "header does not end"
    fields = {}
    for row in data[line.end() : head].split(b"\r\n"):
        key, colon, value = row.partition(b":")
        if colon:
            fields[key.strip().lower()] = value.strip()
    try:
        size = int(fields.get(b"content-length", b""))
    except ValueError:
        return "no length"
    block, end = data[head + 4 : head + 4 + size], head + 4 + size
    if size < 0 or len(block) < size:
        return "cut off"
    if data[end : end + 4] != RECORD_END.encode():
        return "wrong length"
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get(b"content-type", b"").startswith(b"application/http") else block
    stated, verified = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace"), None
    if kind != "revisit":
        digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
        verified = _agrees(stated, payload)
        if verified is False:
            return "wrong digest"
        told = len(payload)
    else:
        digest, told = stated.removeprefix("sha1:"), fields.get(b"warc-payload-length", b"")
        told = int(told) if told.isdigit() else None
    names = {k: fields.get(k.encode(), b"").decode("utf-8", "replace") or None for k in ("warc-record-id", "warc-refers-to", "warc-target-uri")}
    return {
        "record_id": names["warc-record-id"], "record_type": kind, "url": names["warc-target-uri"], "refers_to": names["warc-refers-to"],
        "payload_bytes": told, "payload_digest": digest, "payload": payload if kind != "revisit" else None, "verified": verified,
    }, end + 4


def records(data: bytes) -> Iterator[dict]:
    """All records of an archive, and its gaps; both have offset and end, a gap has an error instead of a record."""
    if data.startswith(_MEMBER):
        for at, content, end in members(data):
            if content is None:
                yield {"at": at, "end": end, "error": "no valid member"}
            else:
                for r in records(content):
                    yield r | {"at": at, "end": end, "within": r["at"]}
        return
    at = 0
    while at < len(data):
        got = _record(data, at)
        if isinstance(got, str):
            after = _VERSION.search(data, at + 1)
            # A member may follow plain damage.
            member = data.find(_MEMBER, at + 1)
            if member >= 0 and (not after or member < after.start()) and any(c is not None for _, c, _ in members(data, member)):
                yield {"at": at, "end": member, "error": got}
                for r in records(data[member:]):
                    yield r | {"at": r["at"] + member, "end": r["end"] + member}
                return
            end = after.start() if after else len(data)
            yield {"at": at, "end": end, "error": got}
            at = end
        else:
            yield got[0] | {"at": at, "end": got[1], "error": None}
            at = got[1]


SCHEMA = (
    "path string, offset long, end_offset long, error string, record_id string, record_type string, url string, refers_to string, "
    "payload_bytes long, payload_digest string, verified boolean, payload binary"
)
_KIND = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("end_offset", pa.int64()), ("error", pa.string())]
    + [(n, pa.string()) for n in ("record_id", "record_type", "url", "refers_to")]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("payload", pa.binary())]
)


def read_archives(spark: SparkSession, path: str, payload: bool = True, names: str = "*") -> DataFrame:
    """Records and quarantined gaps of all archives under ``path`` whose file names match ``names``, one row each; a gap has an error and no record.

    A stated digest is checked by its own algorithm; ``verified`` is null where there is none or the algorithm is unknown.

    A revisit has the length and digest of the payload it stands for, and no payload.  ``payload=False`` leaves the
    payloads out.  An empty archive gives no rows.  A task holds one archive and its records at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for r in records(content.as_py()):
                    body = r.get("payload") if payload else None
                    rows.append({"path": name.as_py(), "offset": r["at"], "end_offset": r["end"]} | {n: r.get(n) for n in _KIND.names[3:-1]} | {"payload": body})
                    held += len(body or b"")
                    if held > 16 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, _KIND)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _KIND)

    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)
    return files.select("path", "content").mapInArrow(read, SCHEMA)


@register(
    "op10_warc",
    """
WITH told AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) % 32 + 1, 1)), '') AS payload_digest FROM told),
found AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM named)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to FROM found
""",
)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)

    def number(c: str) -> Column:
        return F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")

    read = read_archives(spark, path, payload=False).where("error is null")
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
