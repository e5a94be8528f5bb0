"""WARC records in ZIP packages, and a reader that range-reads them.

Writer: each task packs its records into archives of about ``ARCHIVE_BYTES``.
An archive is a ZIP file with two stored (uncompressed) members:
``archive/data.warc.gz``, one gzip member a record, and ``indexes/index.cdxj``,
a line a record with its offset and length in that file.  ZIP64 fields are
written for every size and offset.  Archives are single files in the shared
folder, written by Spark's own file writer, so any store that Spark writes to
will do; its line end after each row is the package's one-character comment.

Reader: Spark lists the packages; tasks find the end-of-central-directory record
(and its ZIP64 form) from the back of each file, read the central directory, locate the
two members and read the index.  That gives a table of (path, page, offset, length);
the rows that are asked for are spread over tasks and read by their ranges.  No member is
extracted, no other record is read, and a package may be of any size.  Ranges
are read through pyarrow's file systems (local, HDFS and object stores).

Of payloads of at least ``MIN_REVISIT`` bytes that are equal, the smallest
page id is a ``response`` and the others are ``revisit`` records without a
payload; the reader resolves those by a join on the digest.

Defined results: NULL html is an empty payload; rows with equal page ids and
payloads are one response each if their id is the smallest; NULL page ids come
last and never are referred to unless alone; an empty table gives no archive
and no records.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.common import Scratch

ARCHIVE_BYTES = 8 << 20
MIN_REVISIT = 100
READ_BYTES = 4 << 20
SPREAD_BYTES = 64 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

_LOCAL = struct.Struct("<4s5H3I2H")
_CENTRAL = struct.Struct("<4s6H3I5H2I")
_END = struct.Struct("<4s4H2IH")
_END64 = struct.Struct("<4sQ2H2I4Q")
_LOCATOR = struct.Struct("<4sIQI")
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


# ---- records -------------------------------------------------------------

def write_record(page_id, url: str | None, kind: str, digest: str, payload: bytes, refers_to) -> bytes:
    """One WARC record, as a gzip member of its own."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>",
        f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"Refers-To-Page: {refers_to}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    block = "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    return gzip.compress(block, compresslevel=4, mtime=0)


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    block = zlib.decompress(member, wbits=31)
    head, _, rest = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


# ---- packages ------------------------------------------------------------

def write_package(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP file of stored members, with ZIP64 records and a one-character comment to come."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, offset = name.encode(), zlib.crc32(data), len(out)
        sizes = struct.pack("<2H2Q", 1, 16, len(data), len(data))
        out += _LOCAL.pack(b"PK\x03\x04", 45, 0, 0, 0, 0x21, crc, _FULL32, _FULL32, len(raw), len(sizes))
        out += raw + sizes + data
        extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), offset)
        central += _CENTRAL.pack(b"PK\x01\x02", 45, 45, 0, 0, 0, 0x21, crc, _FULL32, _FULL32,
                                 len(raw), len(extra), 0, 0, 0, 0, _FULL32) + raw + extra
    begin = len(out)
    out += central
    end64 = len(out)
    out += _END64.pack(b"PK\x06\x06", _END64.size - 12, 45, 45, 0, 0, len(members), len(members), len(central), begin)
    out += _LOCATOR.pack(b"PK\x06\x07", 0, end64, 1)
    out += _END.pack(b"PK\x05\x06", 0, 0, _FULL16, _FULL16, _FULL32, _FULL32, 1)
    return bytes(out)


def central_directory(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of the data of each stored member, from the directories alone.

    ``read(offset, length)`` reads a range of the package, ``size`` is its length.
    """
    tail_at = max(0, size - _END.size - _FULL16)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end-of-central-directory record")
    _, _, _, _, count, length, begin, _ = _END.unpack_from(tail, end)
    if _FULL16 == count or _FULL32 in (length, begin):
        mark, _, at, _ = _LOCATOR.unpack(read(tail_at + end - _LOCATOR.size, _LOCATOR.size))
        if mark != b"PK\x06\x07":
            raise ValueError("ZIP64 locator missing")
        *_, count, length, begin = _END64.unpack(read(at, _END64.size))
    directory = read(begin, length)
    members, at = {}, 0
    for _ in range(count):
        (mark, _, _, _, method, _, _, _, packed, full, n_name, n_extra, n_comment, _, _, _,
         offset) = _CENTRAL.unpack_from(directory, at)
        if mark != b"PK\x01\x02":
            raise ValueError("broken central directory")
        extra_at = at + _CENTRAL.size + n_name
        name = directory[at + _CENTRAL.size: extra_at].decode()
        wide = _zip64_extra(directory[extra_at: extra_at + n_extra])
        if full == _FULL32:
            full = wide.pop(0)
        if packed == _FULL32:
            packed = wide.pop(0)
        if offset == _FULL32:
            offset = wide.pop(0)
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be range-read")
        n_local_name, n_local_extra = struct.unpack("<2H", read(offset + 26, 4))
        members[name] = (offset + _LOCAL.size + n_local_name + n_local_extra, packed)
        at = extra_at + n_extra + n_comment
    return members


def _zip64_extra(extra: bytes) -> list[int]:
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<2H", extra, at)
        if tag == 1:
            return list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
        at += 4 + size
    return []


def _pack(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = bytearray(), []

        def package() -> pa.RecordBatch:
            lines = "".join(index).encode()
            blob = write_package([(DATA, bytes(data)), (INDEX, lines)])
            data.clear()
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["package"])

        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(c) for c in (
                    "page_id", "url", "html", "digest", "refers_to"))):
                page, refers = page.as_py(), refers.as_py()
                kind = "response" if refers is None else "revisit"
                member = write_record(page, url.as_py(), kind, digest.as_py(), (html.as_py() or "").encode(), refers)
                index.append(f"{json.dumps({'page': page, 'offset': len(data), 'length': len(member)})}\n")
                data += member
                if len(data) >= archive_bytes:
                    yield package()
        if index:
            yield package()
    return run


def write_archives(scratch: Scratch, pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, min_revisit: int = MIN_REVISIT) -> str:
    """Writes the archives of ``pages`` and returns their folder."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    # digests of the copies only: one row for each digest that occurs twice or more
    firsts = rows.filter(F.octet_length("html") >= min_revisit).groupBy("digest") \
        .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = scratch.table(firsts, "firsts")
    typed = rows.join(firsts, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_page")), F.col("first_page")))
    packages = typed.select("page_id", "url", "html", "digest", "refers_to") \
        .mapInArrow(_pack(archive_bytes), "package binary")
    path = scratch.path("archives")
    packages.select(F.col("package").cast("string").alias("value")) \
        .write.option("maxRecordsPerFile", 1).text(path)
    return path


class _Package:
    """Ranges of one file, through the file system of its path."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", path))
        self._file = system.open_input_file(name)
        self.bytes_read = 0

    def read(self, offset: int, length: int) -> bytes:
        data = self._file.read_at(length, offset)
        if len(data) != length:
            raise ValueError(f"{length} bytes at {offset} are beyond the file's end")
        self.bytes_read += length
        return data

    def close(self) -> None:
        self._file.close()


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, page_id, offset, length) of every record, from directories and indexes alone."""
    for batch in batches:
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            package = _Package(path)
            members = central_directory(package.read, size)
            base = members[DATA][0]
            lines = [json.loads(line) for line in package.read(*members[INDEX]).splitlines()]
            package.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(lines), pa.string()), pa.array([x["page"] for x in lines], pa.int64()),
                 pa.array([base + x["offset"] for x in lines], pa.int64()), pa.array([x["length"] for x in lines], pa.int64())],
                ["path", "page_id", "offset", "length"])


def _adjoining(rows: list[tuple[str, int, int]], most: int) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of records that follow each other in one file, of at most ``most`` bytes (one record may be longer)."""
    run: list[tuple[str, int, int]] = []
    for row in rows:
        if run and (row[0] != run[-1][0] or row[1] != run[-1][1] + run[-1][2] or row[1] + row[2] - run[0][1] > most):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads the records at (path, offset, length); neighbours in a file are one read."""
    fields = [("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()),
              ("payload", pa.binary()), ("refers_to", pa.int64())]
    opened, package = None, None
    for batch in batches:
        wanted = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))))
        for run in _adjoining(wanted, READ_BYTES):
            if run[0][0] != opened:
                if package:
                    package.close()
                opened, package = run[0][0], _Package(run[0][0])
            begin = run[0][1]
            blob = package.read(begin, run[-1][1] + run[-1][2] - begin)
            rows = []
            for _, offset, length in run:
                head, payload = read_record(blob[offset - begin: offset - begin + length])
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of page {head['Page-ID']} does not match its digest")
                rows.append((int(head["Page-ID"]) if head["Page-ID"] else None, head["WARC-Type"], digest,
                             payload if head["WARC-Type"] == "response" else None,
                             int(head["Refers-To-Page"]) if "Refers-To-Page" in head else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])
    if package:
        package.close()


def locate_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_id, offset, length) of every record of the packages below ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # a listing, no content
    return files.mapInArrow(_locate, "path string, page_id long, offset long, length long")


def read_records(located: DataFrame) -> DataFrame:
    """(page_id, record_type, payload_digest, payload, refers_to) of located records, each read by its range.

    Stretches of ``SPREAD_BYTES`` of a file go to tasks of their own, so a large package is no single task's.
    """
    stretch = F.floor(F.col("offset") / SPREAD_BYTES)
    return located.repartition("path", stretch).sortWithinPartitions("path", "offset").select("path", "offset", "length") \
        .mapInArrow(_fetch, "page_id long, record_type string, payload_digest string, payload binary, refers_to long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the packages below ``path``."""
    return read_records(locate_records(spark, path))


def resolve(records: DataFrame) -> DataFrame:
    """Records with ``payload_bytes`` known for responses; revisits take it from the response they refer to."""
    responses, revisits = (records.filter(F.col("record_type") == kind) for kind in ("response", "revisit"))
    sizes = responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).union(
        revisits.drop("payload_bytes").join(sizes, "payload_digest").select(*columns))
