"""WARC archives: writing with de-duplication by payload, and a salvage reader.

``write`` turns rows into records of gzip members, in archive files of a bounded size in a shared folder; its
manifest names the files of the task attempts that succeeded. ``read`` walks each file; when a member fails
its checks (header, length, CRC, digest), it looks for the next valid member, or in plain archives the next
version line, goes on from there, and reports the bytes in between as quarantined.

Cases: a null payload is empty; equal payloads of at least ``revisit_from`` bytes are stored once, by the smallest
id, and the others are revisit records; rows that repeat that id with that payload are responses too, and rows without an id
refer to it; an empty table writes no archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, stored

VERSION = re.compile(rb"WARC/[0-9]\.[0-9]\r\n")
MAGIC = b"\x1f\x8b\x08"
WINDOW = 1 << 20
LONGEST = 256 << 20  # bytes of the longest record, not zipped
READERS = 100_000  # tasks that read at most
RECORD = "path string, at long, size long, id long, uri string, kind string, refers_to long, digest string, payload_bytes long, payload binary, problem string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(i: int, uri: str, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One record; a revisit holds no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(i))}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: '%%%02X' % ord(m[0]), uri)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Row-Id: {i}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Row-Id: {refers_to}"]
    body = http + (payload if refers_to is None else b"")
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(raw: bytes, path: str = "", at: int = 0, size: int = 0) -> tuple:
    """A row of RECORD from one whole record; ValueError if a check fails."""
    m = VERSION.match(raw)
    split = raw.find(b"\r\n\r\n")
    if not m or split < 0:
        raise ValueError("no record header")
    fields = {}
    for line in raw[m.end() : split].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    try:
        body = raw[split + 4 : split + 4 + (n := int(fields[b"content-length"]))]
    except (KeyError, ValueError):
        raise ValueError("no content length") from None
    if len(body) != n or raw[split + 4 + n :] != b"\r\n\r\n":
        raise ValueError("the length is wrong")
    kind = fields.get(b"warc-type", "")
    payload = body
    if "application/http" in fields.get(b"content-type", ""):
        payload = body[body.find(b"\r\n\r\n") + 4 :]
    sha1 = fields.get(b"warc-payload-digest", "").rpartition(":")[2]
    if kind == "response" and sha1 and digest(payload) != sha1:
        raise ValueError("the payload's digest is wrong")
    number = lambda k: int(fields[k]) if re.fullmatch(r"-?\d+", fields.get(k, "")) else None
    size_told = number(b"x-payload-length")
    return (path, at, size, number(b"x-row-id"), fields.get(b"warc-target-uri"), kind, number(b"x-refers-to-row-id"), sha1, len(payload) if kind == "response" or size_told is None else size_told, payload if kind == "response" else None, None)


class _Source:
    """Bytes of a file by place, read forward in windows; what lies before the cursor is let go."""

    def __init__(self, f):
        self.f, self.buf, self.base, self.done = f, b"", 0, False

    def fill(self, upto: int) -> None:
        """Have the bytes before ``upto``, if the file is as long."""
        parts = [self.buf]
        have = self.base + len(self.buf)
        while have < upto and not self.done:
            part = self.f.read(max(WINDOW, upto - have))
            self.done = not part
            parts.append(part)
            have += len(part)
        self.buf = b"".join(parts)

    def drop(self, at: int) -> None:
        self.buf, self.base = self.buf[at - self.base :], at

    def find(self, what: re.Pattern, at: int) -> int | None:
        """Place of the next match at or after ``at``."""
        while True:
            self.fill(at + WINDOW)
            if m := what.search(self.buf, at - self.base):
                return self.base + m.start()
            end = self.base + len(self.buf)
            if self.done or end < at + WINDOW:
                return None
            at = end - 16
            self.drop(at)


def _member_at(src: _Source, at: int, longest: int) -> tuple[bytes, int]:
    """The content of the gzip member at a place and the place after it; ValueError or zlib.error if it fails its checks or is longer than ``longest``."""
    z, out, pos, size = zlib.decompressobj(31), [], at, 0
    while not z.eof:
        src.fill(pos + WINDOW)
        part = src.buf[pos - src.base : pos - src.base + WINDOW]
        if not part:
            raise ValueError("a cut member")
        pos += len(part)
        while part and not z.eof:
            out.append(z.decompress(part, WINDOW))
            size += len(out[-1])
            if size > longest:
                raise ValueError(f"a member of over {longest} bytes")
            part = z.unconsumed_tail
    return b"".join(out), pos - len(z.unused_data)


def _plain_at(src: _Source, at: int, longest: int) -> tuple[bytes, int]:
    src.fill(at + WINDOW)
    head = src.buf[at - src.base : at - src.base + WINDOW]
    if not VERSION.match(head):
        raise ValueError("no version line")
    split = head.find(b"\r\n\r\n")
    m = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", head[: split + 2]) if split >= 0 else None
    if not m:
        raise ValueError("no content length")
    if len(m[1]) > 18 or int(m[1]) > longest:
        raise ValueError(f"a record of over {longest} bytes")
    end = at + split + 4 + int(m[1]) + 4
    src.fill(end)
    return src.buf[at - src.base : end - src.base], end


NEXT = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]\.[0-9]\r\n")


def salvage(f, path: str = "", longest: int = LONGEST) -> Iterator[tuple]:
    """Rows of RECORD from a file object: records, and for each quarantined gap a row with its problem. A record of over ``longest`` bytes, or that says it is, is quarantined:
    a damaged length is not believed, so memory is bounded by that."""
    src, at, gap, why = _Source(f), 0, None, ""
    while True:
        src.fill(at + len(MAGIC))
        if at >= src.base + len(src.buf):
            break
        try:
            zipped = src.buf.startswith(MAGIC, at - src.base)
            raw, end = (_member_at if zipped else _plain_at)(src, at, longest)
            row = parse(raw, path, at, end - at)
        except (ValueError, zlib.error) as e:
            if gap is None:
                gap, why = at, str(e)
            found = src.find(NEXT, at + 1)
            if found is None:  # ``find`` has come to the end, window by window
                at = src.base + len(src.buf)
                break
            at = found
            continue
        if gap is not None:
            yield (path, gap, at - gap, None, None, "quarantined", None, None, None, None, why)
            gap = None
        yield row
        at = end
        src.drop(at)
    if gap is not None:
        yield (path, gap, at - gap, None, None, "quarantined", None, None, None, None, why)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(df: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", revisit_from: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Write a record per row; the manifest: path, records, bytes of each archive."""
    spark = df.sparkSession
    folder = shared_dir(spark, "warc")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(uri_col).cast("string"), F.lit("")).alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    several = rows.filter(F.length("payload") >= revisit_from).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    first = stored(several.select("sha", "first"), "firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        out, name, records, size, made = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made.append((f"{folder}/{name}", records, size, longest))
                out = None

        for b in batches:
            for i, uri, payload, ref in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    name, records, size, longest = f"{uuid.uuid4().hex}.warc.gz", 0, 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                plain = record(i, uri, payload, digest(payload), ref)
                raw = member(plain)
                out.write(raw)
                records, size, longest = records + 1, size + len(raw), max(longest, len(plain))
                if size >= file_bytes:
                    close()
        close()
        if made:
            p, *n = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p), *(pa.array(x, pa.int64()) for x in n)], names=["path", "records", "bytes", "longest"])

    # a payload that very many rows have is split by Spark's own handling of skewed joins
    refers_to = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    marked = rows.join(first.hint("merge"), "sha", "left").select("id", "uri", "payload", refers_to.alias("refers_to"))
    return stored(marked.mapInArrow(run, "path string, records long, bytes long, longest long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """RECORD rows of every archive that the manifest's ``path`` names. Records of up to LONGEST bytes are read, and longer ones if its ``longest`` knows of such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("id", pa.int64()), ("uri", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])
        for b in batches:
            for path, longest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, place = _file_system(path)
                rows, held = [], 0
                with system.open_input_stream(place, compression=None) as f:
                    for row in salvage(f, path, max(longest or 0, LONGEST)):
                        rows.append(row)
                        held += 200 + len(row[9] or b"")
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    # as many tasks as archives, dealt in turn: a given number is not merged into fewer tasks for being few bytes
    known = F.col("longest").cast("long") if "longest" in manifest.columns else F.lit(None).cast("long")
    n = min(max(1, manifest.count()), READERS)
    return manifest.select("path", known.alias("longest")).orderBy("path").repartition(n).mapInArrow(run, RECORD)
