"""WARC records in ZIP-packaged archives: written by tasks, read back by ranges without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingualoom.session import fresh_path, stage

# Fixed values of the two formats.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
ALL32, ALL16 = 0xFFFFFFFF, 0xFFFF
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Own layout of an archive.
DATA, INDEX = "archive/data.warc.gz", "indexes/records.txt"
DATE = "2026-01-01T00:00:00Z"
# An archive is closed at this size; one read covers this much of it.
ARCHIVE_BYTES = 512 << 20
RANGE_BYTES = 4 << 20
LEVEL = 1

_MANIFEST = "path string, records long, bytes long"
_RANGES = "path string, base long, offsets array<long>, lengths array<long>, error string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record.  A revisit repeats the HTTP head, with the full payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " else c for c in url))
    if revisit:
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """The fields of ``_RECORDS`` from one record; ``ValueError`` if it isn't sound."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("no_record")
    named = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(named["content-length"])]
    if len(block) != int(named["content-length"]):
        raise ValueError("short_record")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = named["warc-payload-digest"].removeprefix("sha1:")

    def number(name: str) -> int | None:
        value = named.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    kind = named["warc-type"]
    if kind == "response" and (len(payload) != said or base32_sha1(payload) != digest):
        raise ValueError("bad_digest")
    return number("warc-record-id"), named.get("warc-target-uri"), said, digest, kind, number("warc-refers-to"), payload if kind == "response" else None, None


def assign_roles(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Adds ``refers_to``: for a page that only repeats a payload, the smallest id with that payload.

    Only digests and ids are aggregated (smallest id by digest, combined before the shuffle); the join back has one
    row per digest on one side, so Spark can split a payload that very many pages share.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(payload).alias("digest")
    )
    firsts = stage(rows.groupBy("digest").agg(F.min("page_id").alias("first")), "first-pages")
    repeats = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= least_bytes)
    return rows.join(firsts, "digest").select("page_id", "url", "html", F.when(repeats, F.col("first")).alias("refers_to"))


def write_archives(roles: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row into archives below ``folder``; returns the manifest ``path, records, bytes``.

    Each task writes archives under names of its own and reports them in its result.  The manifest
    is itself written as a table, so archives of tasks that failed or ran twice are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _open(folder)
        filesystem.create_dir(root, recursive=True)
        pages = ((p.as_py(), u.as_py(), (h.as_py() or "").encode("utf-8", "surrogatepass"), r.as_py()) for b in batches for p, u, h, r in zip(*b.columns, strict=True))
        page = next(pages, None)
        while page is not None:
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            with filesystem.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
                index, at = [], 0
                with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
                    while page is not None and at < archive_bytes:
                        page_id, url, html, refers_to = page
                        packed = gzip.compress(record(page_id, url, html, refers_to, refers_to is not None), LEVEL, mtime=0)
                        data.write(packed)
                        index.append(f"{at} {len(packed)}\n")
                        at += len(packed)
                        page = next(pages, None)
                package.writestr(zipfile.ZipInfo(INDEX), "".join(index))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([len(index)]), pa.array([at])], ["path", "records", "bytes"])

    return stage(roles.select("page_id", "url", "html", "refers_to").mapInArrow(run, _MANIFEST), "warc-manifest")


def directory(source: pa.NativeFile) -> dict[str, tuple[int, int, int]]:
    """``name -> (method, start of the data, size)`` of each member, from the central directory alone.

    ``ValueError`` names what is wrong with a damaged package.
    """
    size = source.size()
    tail_at = max(0, size - ALL16 - 22)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(END)
    if end < 0 or len(tail) < end + 22:
        raise ValueError("no_directory")
    length, start = struct.unpack_from("<II", tail, end + 12)
    if end >= 20 and tail[end - 20 : end - 16] == LOCATOR64:
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        end64 = source.read_at(56, at)
        if end64[:4] != END64:
            raise ValueError("bad_zip64")
        length, start = struct.unpack_from("<QQ", end64, 40)
    if start + length > size:
        raise ValueError("bad_directory")
    listing, at, found = source.read_at(length, start), 0, {}
    while at < length:
        if listing[at : at + 4] != ENTRY or len(listing) < at + 46:
            raise ValueError("bad_directory")
        method, packed, full = struct.unpack_from("<H8xII", listing, at + 10)
        name_n, extra_n, note_n = struct.unpack_from("<HHH", listing, at + 28)
        (local,) = struct.unpack_from("<I", listing, at + 42)
        name = listing[at + 46 : at + 46 + name_n].decode("utf-8", "replace")
        extra = listing[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                # The wide fields are there in this order, and only for those that overflow.
                full = next(wide, full) if full == ALL32 else full
                packed = next(wide, packed) if packed == ALL32 else packed
                local = next(wide, local) if local == ALL32 else local
            extra = extra[4 + n :]
        header = source.read_at(30, local)
        if header[:4] != LOCAL:
            raise ValueError("bad_member")
        skip = sum(struct.unpack_from("<HH", header, 26))
        found[name] = (method, local + 30 + skip, packed)
        at += 46 + name_n + extra_n + note_n
    return found


def locate(paths: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of records in each archive, from its directory and its index.

    An archive that can't be read becomes one row with an ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p.as_py() for b in batches for p in b.column(0)):
            rows: list[tuple] = []
            try:
                filesystem, name = _open(path)
                with filesystem.open_input_file(name) as source:
                    members = directory(source)
                    if DATA not in members or INDEX not in members:
                        raise ValueError("no_member")
                    if members[DATA][0] or members[INDEX][0]:
                        raise ValueError("not_stored")
                    _, at, size = members[INDEX]
                    offsets, lengths, held = [], [], 0
                    for line in source.read_at(size, at).splitlines():
                        offset, length = map(int, line.split())
                        offsets.append(offset)
                        lengths.append(length)
                        held += length
                        if held >= range_bytes:
                            rows.append((path, members[DATA][1], offsets, lengths, None))
                            offsets, lengths, held = [], [], 0
                    if offsets:
                        rows.append((path, members[DATA][1], offsets, lengths, None))
            except (OSError, ValueError, struct.error) as bad:
                rows = [(path, None, None, None, str(bad) if isinstance(bad, ValueError) else type(bad).__name__)]
            if rows:
                yield _batch(rows, _RANGE_SCHEMA)

    return paths.select("path").mapInArrow(run, _RANGES)


_RANGE_SCHEMA = pa.schema(
    [("path", pa.string()), ("base", pa.int64()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("error", pa.string())]
)
_RECORD_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives named in ``path``: one row each, with an ``error`` instead where one isn't sound.

    Archives are located first and their ranges then spread over all tasks, so a large archive is
    read by many.  A range is one read; nothing is extracted to disk.  ``payload`` is null for
    revisits, and always if ``payloads`` is false.
    """
    ranges = stage(locate(paths), "warc-ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (None,) * 7
        for batch in batches:
            for path, base, offsets, lengths, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if error:
                    yield _batch([(*empty, error)], _RECORD_SCHEMA)
                    continue
                rows = []
                filesystem, name = _open(path)
                with filesystem.open_input_file(name) as source:
                    first = offsets[0]
                    data = source.read_at(offsets[-1] + lengths[-1] - first, base + first)
                for offset, length in zip(offsets, lengths, strict=True):
                    try:
                        found = parse_record(zlib.decompress(data[offset - first : offset - first + length], 31))
                        rows.append(found if payloads else (*found[:6], None, None))
                    except (ValueError, KeyError, StopIteration, zlib.error) as bad:
                        rows.append((*empty, str(bad) if isinstance(bad, ValueError) else type(bad).__name__))
                yield _batch(rows, _RECORD_SCHEMA)

    return ranges.repartition("path", "base", F.col("offsets")[0]).mapInArrow(run, _RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", html_col: str = "html", payloads: bool = False) -> DataFrame:
    """Write a record per page into archives in the shared folder and read them back.

    Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id is
    a response and the others are revisits that refer to it; smaller payloads are all responses.
    Null html is an empty payload, a null url gives no target.  Rows that repeat the smallest id
    are all responses; a page without an id is a response only if no page with that payload has
    one.  An empty table gives no archives and no records.  Other columns are not read.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    manifest = write_archives(assign_roles(pages, least_bytes, id_col, html_col), folder)
    return read_archives(manifest.select("path"), payloads)
