"""WARC archives inside ZIP packages: written by tasks, read back by range without extraction.

A package holds stored members: ``*.warc.gz`` files, every record of which is a gzip member of its own, and
last ``index.jsonl.gz`` with the place of each record. The reader parses the end record, the ZIP64
locator and end record where there are any, and the central directory; finds a member's data behind its local
header; and reads single records by their range. Packages are opened by URI through Arrow's file systems,
so the shared folder may be any store that they reach.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import attach_group, materialize, scratch_path, utf8_slices

#: Signatures and sizes of the ZIP format (fixed values of its specification).
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
INDEX = "index.jsonl.gz"
_FULL = 0xFFFFFFFF


# --- reading -----------------------------------------------------------------------------------------------

ReadAt = Callable[[int, int], bytes]


def _zip64_fields(extra: bytes, want: list[bool]) -> list[int]:
    """The 8-byte values of the ZIP64 extra field, for those of the wanted fields that are full."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            return list(struct.unpack_from(f"<{sum(want)}Q", extra, at + 4))
        at += 4 + size
    raise ValueError("a ZIP64 size without its extra field")


def directory(read_at: ReadAt, size: int) -> dict[str, tuple[int, int]]:
    """``{member name: (offset of its local header, stored size)}`` from the central directory."""
    tail_size = min(size, 22 + 65535 + 20)
    tail = read_at(size - tail_size, tail_size)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no ZIP end record")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == LOCATOR64:
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        record = read_at(at, 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end record where the locator points")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    elif count == 0xFFFF or _FULL in (length, start):
        raise ValueError("a ZIP64 package without a locator")
    found, raw, at = {}, read_at(start, length), 0
    for _ in range(count):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", raw, at + 10)[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        (offset,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + n_name].decode()
        full = [plain == _FULL, packed == _FULL, offset == _FULL]
        if any(full):
            values = iter(_zip64_fields(raw[at + 46 + n_name : at + 46 + n_name + n_extra], full))
            plain, packed, offset = (next(values) if f else v for f, v in zip(full, (plain, packed, offset), strict=True))
        if method == 0:
            found[name] = (offset, packed)
        at += 46 + n_name + n_extra + n_comment
    return found


def member_start(read_at: ReadAt, offset: int) -> int:
    """Where a member's data begin: behind its local header, name and extra field."""
    head = read_at(offset, 30)
    if head[:4] != LOCAL:
        raise ValueError("no local header where the directory points")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return offset + 30 + n_name + n_extra


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """``(WARC headers, HTTP header block, payload)`` of one gzip member."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


# --- writing -----------------------------------------------------------------------------------------------


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: a ``response`` with its payload, or a ``revisit`` with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c if 32 < ord(c) != 127 else "%20" for c in url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_package(out, records: Iterator[tuple[object, bytes]], member_bytes: int = 32 << 20, zip64: bool = False) -> int:
    """Stream ``(page_id, gzip member)`` pairs into a ZIP package; members roll over at ``member_bytes``."""
    index, count, number = io.BytesIO(), 0, 0
    lines = zlib.compressobj(1, zlib.DEFLATED, 31)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        member, at = None, 0
        for page_id, raw in records:
            if member is None or at >= member_bytes:
                if member:
                    member.close()
                name, at, number = f"data-{number:05d}.warc.gz", 0, number + 1
                member = package.open(name, "w", force_zip64=zip64 or len(raw) >= 1 << 30)
            member.write(raw)
            index.write(lines.compress(json.dumps([page_id, name, at, len(raw)]).encode() + b"\n"))
            at, count = at + len(raw), count + 1
        if member:
            member.close()
        index.write(lines.flush())
        with package.open(INDEX, "w", force_zip64=zip64) as last:
            last.write(index.getbuffer())
    return count


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", package_bytes: int = 256 << 20) -> DataFrame:
    """Write every row as a record; gives the manifest ``uri, bytes, records`` of the packages that count.

    Of the records with equal payloads (length and SHA-1) of at least ``least_bytes`` bytes, the one with the
    smallest id is the response and the others revisit it. A task names its packages anew at each
    attempt, and only those in the manifest are read, so a lost executor leaves nothing that counts.
    A package rolls over at ``package_bytes``, so a task holds one record at a time and an index of one package.
    """
    spark = pages.sparkSession
    folder = path or scratch_path(spark, "warc")
    body = F.coalesce(F.col(payload_col), F.lit("")).alias("payload")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    keys = materialize(rows.select("page_id", F.octet_length("payload").alias("size"), "sha"), "digests")
    firsts = attach_group(keys.where(F.col("size") >= least_bytes), ["size", "sha"], "page_id", [F.min("page_id").alias("refers_to")])
    revisits = firsts.where("page_id <> refers_to").select("page_id", "sha", "refers_to").distinct()
    rows = rows.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "payload", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)

        def records() -> Iterator[tuple[object, bytes]]:
            for batch in utf8_slices(batches, 2):
                for page, url, text, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = text.encode("utf-8", "surrogatepass")
                    yield page, build_record(page, url, payload, sha1_base32(payload), refers)

        source, held = records(), []
        while first := next(source, None):
            held, left = [first], [package_bytes]

            def some(held=held, left=left) -> Iterator[tuple[object, bytes]]:
                yield held.pop()
                while left[0] > 0 and (record := next(source, None)):
                    left[0] -= len(record[1])
                    yield record

            name = f"part-{uuid.uuid4().hex}.zip"
            with system.open_output_stream(f"{root}/{name}") as out:
                count = write_package(out, some())
            size = system.get_file_info(f"{root}/{name}").size
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["uri", "bytes", "records"])

    return materialize(rows.mapInArrow(write, "uri string, bytes long, records long"), "manifest")


def _open(uri: str) -> tuple[ReadAt, int]:
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    source = system.open_input_file(path)
    return (lambda at, length: source.read_at(length, at)), source.size()


def read_index(manifest: DataFrame) -> DataFrame:
    """``uri, start, length``: the byte range of every record, from the packages' directories and indexes."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                read_at, size = _open(uri)
                members = directory(read_at, size)
                starts = {name: member_start(read_at, offset) for name, (offset, _) in members.items()}
                lines = zlib.decompress(read_at(starts[INDEX], members[INDEX][1]), 31).splitlines()
                rows = [json.loads(x) for x in lines]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(rows), pa.string()), pa.array([starts[m] + at for _, m, at, _ in rows], pa.int64()), pa.array([n for *_, n in rows], pa.int64())], ["uri", "start", "length"])

    return manifest.select("uri").mapInArrow(ranges, "uri string, start long, length long")


def read_records(ranges: DataFrame, payloads: bool = False) -> DataFrame:
    """Range-read records: ``page_id, payload_bytes, payload_digest, record_type, refers_to, intact[, url, payload]``.

    ``intact`` says that a response's payload has the digest and length its headers give.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, ReadAt] = ("", None)
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = []
                for uri, start, length in zip(*(c.to_pylist() for c in batch.slice(part, 500).columns), strict=True):
                    if uri != opened[0]:
                        opened = (uri, _open(uri)[0])
                    headers, http, payload = parse_record(opened[1](start, length))
                    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    number = lambda x: None if x in (None, "<urn:page:None>") else int(x[10:-1])
                    intact = kind == "revisit" or (len(payload) == size and sha1_base32(payload) == digest)
                    rows.append((number(headers["WARC-Record-ID"]), size, digest, kind, number(headers.get("WARC-Refers-To")), intact, headers["WARC-Target-URI"], payload)[: 8 if payloads else 6])
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "url", "payload"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.binary()]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names[: 8 if payloads else 6])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
    return ranges.mapInArrow(read, schema + (", url string, payload binary" if payloads else ""))


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, **columns: str) -> DataFrame:
    """Write ``pages`` to packages and read every record back through the packages' directories.

    Edge cases: a null payload is empty; a null id is written as ``None`` and read back as null, always as a
    response; of rows that repeat the smallest id of a group each is a response; an empty table writes no
    package and gives an empty table; a null url becomes ``about:blank``; other columns are not read.
    Raises if a record read back does not have its digest.
    """
    manifest = write_archives(pages, least_bytes=least_bytes, **columns)
    spread = materialize(read_index(manifest), "record-ranges")
    found = read_records(spread)
    sound = F.when(F.col("intact"), F.lit(True)).otherwise(F.raise_error(F.lit("a record read back differs from its digest")).cast("boolean"))
    return found.where(sound).drop("intact")
