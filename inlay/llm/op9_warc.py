"""WARC archives: a writer with payload de-duplication and a splittable reader.

Each record is a gzip member of its own.  The reader's tasks scan byte ranges for the
gzip magic, accept a place where a member with a WARC header decodes, and own the
records that start inside their range; from an accepted place on they go member by
member.  Members of one file carry the file's own mark in the gzip header, so archives
stored inside a payload are not mistaken for records; files without marks are read too.

Of payloads that are equal and have ``REVISIT_BYTES`` bytes or more, the one with the
largest page id is a response and the others revisit it (rows that tie for the largest
id are all responses; null ids come before any other).  Null payloads are empty, a null
URL stays away, an empty table gives no archives, other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from inlay.llm import queries
from inlay.llm.common import materialize, new_path, table
from inlay.llm.words import utf8

REVISIT_BYTES = 1000
FILE_BYTES = 1 << 30  # a task starts another file beyond this size
SPLIT_BYTES = 8 << 20
LEVEL = 1
CHUNK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
PAGE_URN = "urn:page:"
MANIFEST = "path string, bytes bigint, records bigint"
RECORDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared path and the path in it."""
    local = re.sub(r"^file:/*", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def member(raw: bytes, mark: bytes, level: int = LEVEL) -> bytes:
    """``raw`` as a gzip member whose header carries ``mark``."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    extra = b"IM" + struct.pack("<H", len(mark)) + mark
    head = MAGIC + b"\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + deflate.compress(raw) + deflate.flush() + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def urn(page_id: int | None) -> str:
    return f"<{PAGE_URN}{'' if page_id is None else page_id}>"


def from_urn(text: str) -> int | None:
    value = text.strip("<>").removeprefix(PAGE_URN)
    return int(value) if value else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """A response, or a revisit of the record ``refers_to`` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    if refers_to:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a decoded record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


def with_roles(pages: DataFrame) -> DataFrame:
    """``page_id, url, body, digest, size, refers_to`` of ``pages(page_id, url, html)``."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint"), "url", body.alias("body"))
    rows = rows.withColumns({"size": F.octet_length("body").cast("bigint"), "digest": F.sha1("body"), "strong": F.sha2("body", 256)})
    copies = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("size", "digest", "strong")
    latest = copies.agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(latest, ["size", "digest", "strong"], "left")
    later = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return met.select("page_id", "url", "body", "digest", "size", F.when(later, F.col("latest")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, level: int = LEVEL, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row under ``folder``; returns the stored list of files.

    An attempt writes files of its own, and only those of attempts that committed are in
    the list, so a task that is run twice leaves no record twice.
    """
    rows = with_roles(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        out: BinaryIO | None = None
        name, mark, done, n = "", b"", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([done], pa.int64()), pa.array([n], pa.int64())],
                ["path", "bytes", "records"],
            )

        for batch in batches:
            at, data = utf8(batch.column(2))
            ids, urls, _, digests, sizes, refers = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                if out is None:
                    name, mark, done, n = f"{uuid.uuid4().hex}.warc.gz", os.urandom(12), 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None, buffer_size=CHUNK)
                target = refers[i].as_py()
                page_id, payload = ids[i].as_py(), data[at[i] : at[i + 1]].tobytes()
                raw = record(
                    page_id, urls[i].as_py(), payload, digests[i].as_py(), sizes[i].as_py(),
                    None if target is None else urn(target),
                )
                packed = member(raw, mark, level)
                out.write(packed)
                done, n = done + len(packed), n + 1
                if done >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialize(rows.mapInArrow(run, MANIFEST), "archives")


class Window:
    """Random reads of one file through a buffer."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(min(max(n, CHUNK), self.size - at))
        return self.data[at - self.start : at - self.start + n]


def mark_at(source: Window, at: int) -> bytes | None:
    """The gzip extra field of the member at ``at``; empty without one, None where no header is."""
    head = source.read(at, 12)
    if not head.startswith(MAGIC):
        return None
    if len(head) < 12 or not head[3] & 4:
        return b""
    return source.read(at + 12, struct.unpack("<H", head[10:12])[0])


class DamagedRecord(ValueError):
    """A member of an archive that begins like a record and can't be read."""


def begins_record(source: Window, at: int, mark: bytes) -> bool:
    """Whether a member of this file with a WARC header starts at ``at``."""
    if mark_at(source, at) != mark:
        return False
    try:
        return zlib.decompressobj(31).decompress(source.read(at, 4096), 5) == b"WARC/"
    except zlib.error:
        return False


def decoded(source: Window, at: int) -> tuple[bytes, int] | None:
    """The whole member at ``at`` and the place behind it; None if it doesn't decode."""
    inflate, out, place = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof:
            chunk = source.read(place, CHUNK)
            if not chunk:
                return None
            out.append(inflate.decompress(chunk))
            place += len(chunk)
    except zlib.error:
        return None
    return b"".join(out), place - len(inflate.unused_data)


def records_in(source: Window, start: int, end: int) -> Iterator[bytes]:
    """Decoded records that start in ``[start, end)``."""
    mark = mark_at(source, 0)
    at = start
    while at < end:
        if mark is not None and begins_record(source, at, mark):
            found = decoded(source, at)
            if found is None:  # never left out without a word
                raise DamagedRecord(f"record at byte {at} has a header but does not decode")
            raw, at = found
            yield raw
            continue
        # to the next magic that starts before the end of the range
        at += 1
        while at < end:
            chunk = source.read(at, min(CHUNK, end - at + len(MAGIC) - 1))
            place = chunk.find(MAGIC)
            if place >= 0:
                at += place
                break
            at += max(1, len(chunk) - len(MAGIC) + 1)


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """Records of ``files(path, bytes)``; ``payloads`` adds the payload (null for revisits).

    A response's digest and size are those of the payload that was read, checked against
    the header; a revisit states those of the payload it stands for.
    """
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    n = max(1, ranges.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = filesystem(path)
                with system.open_input_file(name) as file:
                    rows, held = [], 0
                    for raw in records_in(Window(file, size), start, min(size, start + split_bytes)):
                        row = row_of(raw)
                        if row is None:
                            continue
                        rows.append(row if payloads else row[:-1])
                        held += len(raw)
                        if len(rows) == 1000 or payloads and held > 8 * CHUNK:
                            yield packed_rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield packed_rows(rows)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(arrays, [f"c{i}" for i in range(len(arrays))])

    schema = RECORDS + (", payload binary" if payloads else "")
    return ranges.repartition(n, "path", "start").mapInArrow(run, schema)


def row_of(raw: bytes) -> tuple | None:
    """The columns of a decoded response or revisit; None for records of other types."""
    fields, block = parse(raw)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    url = fields.get("warc-target-uri")
    if url is not None:
        url = re.sub("%([0-9A-F]{2})", lambda c: chr(int(c[1], 16)), url)
    page = from_urn(fields["warc-record-id"])
    if kind == "revisit":
        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
        return page, url, kind, from_urn(fields["warc-refers-to"]), size, stated, None
    digest = hashlib.sha1(body).hexdigest()
    if digest != stated:
        raise ValueError(f"payload of {fields['warc-record-id']} does not have its stated digest")
    return page, url, kind, None, len(body), digest, body


SQL = """
with sized as (select page_id, sha1(coalesce(html, '')) as payload_digest, strlen(coalesce(html, ''))::bigint as payload_bytes,
  sha256(coalesce(html, '')) as strong from pages),
roles as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_bytes, strong) end as latest
  from sized)
select page_id, payload_bytes, payload_digest, case when latest is null or page_id is not distinct from latest
  then 'response' else 'revisit' end as record_type, case when latest is not null and latest is distinct from page_id then latest end as refers_to from roles"""


@queries.query("op9_warc", SQL)
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    files = write_archives(pages, new_path(spark, "warc"))
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
