"""WARC archives: writing, and a salvage reader.

Writing: each record is a gzip member of its own; Spark writes the members with the text sink, between them an empty member
as separator, so every part file is a valid multi-member `.warc.gz` stream in the cluster's shared folder. Of records with
equal payloads the one with the smallest id is a `response`, the others are `revisit` records without a body.

Reading: files are read whole with Spark's binaryFile source (bounded by `records_per_file` when written here) and parsed in
tasks. A member that fails its checks (gzip CRC, version line, headers, Content-Length, block digest) is quarantined: the
reader searches for the next gzip magic or, in plain data, the next version line at a line start, goes on from there and logs
the skipped bytes as a gap row.

Defined results: null or empty payloads are records with an empty block; null target addresses write no WARC-Target-URI; null
ids sort first and are written as empty; repeated rows are records of their own, all but the first of equal payload being
revisits of the smallest id; an empty table writes and reads no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.linking import narrowed
from claimloom.storage import materialize, new_path

VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member, the separator between the members of a part file.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
RECORDS_PER_FILE = 4_000
#: Bytes of an archive that a decompressor takes at a time.
PIECE = 1 << 14
#: A header of more bytes counts as damaged.
_HEAD_BYTES = 1 << 20
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
RECORD_SCHEMA = "file string, start bigint, end bigint, kind string, reason string, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
_ARROW = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("record_id", pa.string()), ("record_type", pa.string())]
    + [("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def render(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record's gzip member. A revisit (refers_to given) has no block; the payload's length is kept in a header."""
    own = digest(payload)
    block = b"" if refers_to is not None else payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: text/html",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"WARC-Payload-Digest: sha1:{own}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    head = VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", 6, mtime=0)


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """(record_id, url, payload, refers_to) for each row. Only ids and digests are grouped; payloads of at least `min_bytes`
    bytes take part."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    named = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), body.alias("payload"))
    keyed = named.withColumn("same", F.when(F.octet_length("payload") >= min_bytes, F.sha2("payload", 256)))
    first = keyed.where(F.col("same").isNotNull()).groupBy("same").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = materialize(first.where("n > 1").select("same", "first"), "repeated")
    # payloads stay where they are unless the list is too large to broadcast
    out = keyed.join(narrowed(again), "same", "left")
    repeated = F.col("first").isNotNull() & (F.col("id") != F.col("first"))
    return out.select(F.col("id").cast("string").alias("record_id"), "url", "payload", F.when(repeated, F.col("first").cast("string")).alias("refers_to"))


def write(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the planned records as multi-member gzip archives below `path`."""

    def members(batches):
        for batch in batches:
            ids, urls, bodies, refers = (batch.column(k).to_pylist() for k in range(4))
            yield pa.RecordBatch.from_arrays([pa.array([render(i or "", u, b, r) for i, u, b, r in zip(ids, urls, bodies, refers, strict=True)], pa.binary())], names=["member"])

    raw = records.mapInArrow(members, "member binary").select(F.expr("cast(member as string)").alias("value"))
    raw.write.option("maxRecordsPerFile", records_per_file).option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _parse(data: bytes, at: int) -> dict:
    """The record that starts at `at`; ValueError with the reason if a check fails."""
    version = _VERSION_LINE.match(data, at)
    if not version:
        raise ValueError("version line")
    stop = data.find(b"\r\n\r\n", version.end(), version.end() + _HEAD_BYTES)
    if stop < 0:
        raise ValueError("headers")
    fields = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("headers")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise ValueError("content length")
    begin = stop + 4
    end = begin + int(fields["content-length"])
    block = data[begin:end]
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("content length")
    stated = fields.get("warc-block-digest", "").removeprefix("sha1:")
    if stated and stated != digest(block):
        raise ValueError("block digest")
    kind = fields.get("warc-type", "")
    payload_digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or digest(block)
    size = fields.get("x-payload-length", "")
    return {
        "record_id": _page(fields.get("warc-record-id")),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload_digest": payload_digest,
        "payload_bytes": int(size) if size.isdigit() else len(block),
        "payload": block if kind != "revisit" else None,
        "end": end + 4,
    }


def _page(name: str | None) -> str | None:
    return name.removeprefix("<urn:page:").removesuffix(">") if name is not None else None


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member that starts at `at`."""
    engine, parts, view, fed = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not engine.eof and fed < len(data):  # in pieces: what follows the member is copied at most once a piece
            parts.append(engine.decompress(view[fed : fed + PIECE]))
            fed = min(fed + PIECE, len(data))
    except zlib.error as error:
        raise ValueError("gzip") from error
    if not engine.eof:
        raise ValueError("gzip cut off")
    return b"".join(parts), fed - len(engine.unused_data)


class _Restarts:
    """The next place where a member or a record may begin; what lies ahead is searched once, also if nothing is found."""

    def __init__(self, data: bytes):
        self.data, self.magic, self.version = data, -1, -1

    def after(self, at: int) -> int:
        if self.magic < at:
            found = self.data.find(MAGIC, at)
            self.magic = found if found >= 0 else len(self.data)
        if self.version < at:
            line = _VERSION_LINE.search(self.data, at)
            self.version = line.start() if line else len(self.data)
        return min(self.magic, self.version)


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record) for each record that passes its checks, (start, end, reason) for each quarantined gap. Records of
    a gzip member carry the member's place; a gap inside a member names its place in the content."""
    at = gap = 0
    reason, restarts = "", _Restarts(data)
    while at < len(data):
        try:
            if data.startswith(EMPTY_MEMBER, at):
                found, end = [], at + len(EMPTY_MEMBER)
            elif data.startswith(MAGIC, at):
                content, end = _member(data, at)
                found = [x if isinstance(x, dict) else f"{x}, bytes {a}-{b} of the content" for a, b, x in salvage(content)]
            else:
                found = [_parse(data, at)]
                end = found[0]["end"]
        except ValueError as error:
            reason = reason or str(error)
            at = restarts.after(at + 1)
            continue
        if gap < at:
            yield gap, at, reason or "no record"
        for item in found:
            yield at, end, item
        at = gap = end
        reason = ""
    if gap < len(data):
        yield gap, len(data), reason or "no record"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record (kind `record`) and per quarantined byte gap (kind `gap`) of the archives below `path`."""

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for start, end, found in salvage(content.as_py()):
                    row = {"kind": "gap", "reason": found} if isinstance(found, str) else {"kind": "record"} | found
                    row |= {"file": name, "start": start, "end": end}
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write `pages` to new archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write(plan(pages, **options), path)
    return read(pages.sparkSession, path)
