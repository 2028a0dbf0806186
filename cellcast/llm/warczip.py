"""Web archives packaged in ZIP files: written by tasks, read back record by record."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_width, work_path

DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.jsonl", "datapackage.json"
RECORD_ID = "urn:x-page:"
#: Bytes of archive data after which a task begins a new package.
PACKAGE_BYTES = 64 << 20

# Fixed values of the ZIP format: signatures and the marks that stand for "see ZIP64".
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
MARK16, MARK32, ZIP64_FIELD = 0xFFFF, 0xFFFFFFFF, 1


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Member(NamedTuple):
    """A stored member: where its bytes begin in the package, and how many there are."""

    start: int
    size: int


class Package:
    """Reads a ZIP package by ranges; ``source`` has read_at(bytes, offset), as Arrow files."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        self.members = self._members()

    def _at(self, offset: int, count: int) -> bytes:
        got = bytes(self.source.read_at(count, offset))
        if len(got) != count:
            raise ValueError(f"package ends inside a range of {count} bytes at {offset}")
        return got

    def _directory(self) -> tuple[int, int, int]:
        """Entries, bytes and offset of the central directory."""
        span = min(self.size, 22 + MARK16)
        tail = self._at(self.size - span, span)
        at = len(tail)
        while (at := tail.rfind(END, 0, at)) >= 0:
            if at + 22 <= len(tail):
                fields = struct.unpack_from("<4s4H2LH", tail, at)
                if at + 22 + fields[7] == len(tail):  # else the mark is part of a comment
                    break
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, offset = fields[4:7]
        if MARK16 == count or MARK32 in (length, offset):
            locator = struct.unpack("<4sLQL", self._at(self.size - span + at - 20, 20))
            if locator[0] != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            end = struct.unpack("<4sQ2H2L4Q", self._at(locator[2], 56))
            if end[0] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, offset = end[7:10]
        return count, length, offset

    def _members(self) -> dict[str, Member]:
        count, length, offset = self._directory()
        table, at, members = self._at(offset, length), 0, {}
        for _ in range(count):
            entry = struct.unpack_from("<4s6H3L5H2L", table, at)
            if entry[0] != CENTRAL:
                raise ValueError("broken central directory")
            flags, method = entry[3], entry[4]
            packed, size, names, extras, comments = entry[8:13]
            begin = entry[16]
            name = table[at + 46 : at + 46 + names]
            extra = table[at + 46 + names : at + 46 + names + extras]
            wide = _zip64_values(extra)
            # the wide values stand in this order, each only where its 32-bit place is marked
            size = next(wide) if size == MARK32 else size
            packed = next(wide) if packed == MARK32 else packed
            begin = next(wide) if begin == MARK32 else begin
            if method == 0 and not flags & 1:
                head = struct.unpack("<4s5H3L2H", self._at(begin, 30))
                if head[0] != LOCAL:
                    raise ValueError("broken local header")
                text = name.decode("utf-8" if flags & 0x800 else "cp437")
                members[text] = Member(begin + 30 + head[9] + head[10], packed)
            at += 46 + names + extras + comments
        return members

    def read(self, name: str, offset: int = 0, count: int | None = None) -> bytes:
        """A range of a stored member, without reading what lies around it."""
        member = self.members[name]
        count = member.size - offset if count is None else count
        if offset < 0 or offset + count > member.size:
            raise ValueError("range outside the member")
        return self._at(member.start + offset, count)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """WARC headers and blocks, found through the package's index."""
        for line in self.read(INDEX).splitlines():
            entry = json.loads(line)
            yield parse_record(gzip.decompress(self.read(DATA, entry["offset"], entry["length"])))


def _zip64_values(extra: bytes) -> Iterator[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == ZIP64_FIELD:
            yield from struct.unpack_from(f"<{size // 8}Q", extra, at + 4)
        at += 4 + size


def _line(text: str) -> str:
    """A header value on one line; control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def build_record(page_id, url: str | None, payload: bytes, kind: str, digest: str, refers_to) -> bytes:
    """One gzipped WARC record; a revisit keeps the HTTP head and drops the payload."""
    name = lambda i: f"<{RECORD_ID}{'' if i is None else i}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if kind == "response" else b"")
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": name(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        headers["WARC-Target-URI"] = _line(url)
    if kind == "revisit":
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        headers["WARC-Refers-To"] = name(refers_to)
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", 1, mtime=0)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = _headers(head)
    return headers, rest[: int(headers["content-length"])]


class _Writer:
    """A package under way: the data member is open until the package is closed."""

    def __init__(self, filesystem, path: str):
        self.path, self.stream = path, filesystem.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.offset, self.index = 0, []

    def add(self, record: bytes) -> None:
        self.data.write(record)
        self.index.append(f'{{"offset": {self.offset}, "length": {len(record)}}}\n')
        self.offset += len(record)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(INDEX, "".join(self.index))
        self.zip.writestr(ABOUT, json.dumps({"profile": "data-package", "records": len(self.index)}))
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index)


def record_plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows (page_id, url, payload, sha, record_type, refers_to) of what is to be written.

    Payloads are equal when SHA-1 and length are. Of equal payloads of ``min_bytes`` or more
    the row with the smallest page_id is the response, the others revisit it; rows that share
    this id are all responses. Rows without page_id come last: they revisit a row that has
    one, else they are responses. Only (digest, page_id) is gathered before the join.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload"))
    firsts = cut_lineage(
        rows.where(F.col("bytes") >= min_bytes)
        .groupBy("sha", "bytes")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "warc-firsts",
    )
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts.hint("merge"), ["sha", "bytes"], "left").select(
        "page_id",
        "url",
        "payload",
        "sha",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def write_packages(plan: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes the planned records into ZIP packages; rows (path, records) of those to read.

    ``folder`` must be one that all executors share, in a store Arrow can write (a shared
    mount, HDFS, an object store). File names carry the task attempt, so a repeated attempt
    never touches files of another; packages of failed attempts are in no returned row.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        attempt, number, writer, done = TaskContext.get().taskAttemptId(), 0, None, []
        for batch in batches:
            for row in zip(*(column for column in batch.columns)):
                page_id, url, payload, sha, kind, refers_to = (v.as_py() for v in row)
                if writer is None:
                    writer = _Writer(filesystem, f"{root}/part-{attempt}-{number}.wacz")
                    number += 1
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                writer.add(build_record(page_id, url, payload, kind, digest, refers_to))
                if writer.offset >= package_bytes:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        paths, counts = zip(*done) if done else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"]
        )

    return cut_lineage(plan.mapInArrow(write, "path string, records bigint"), "warc-manifest")


def read_packages(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the packages in ``manifest``, one row each.

    Columns page_id, url, record_type, refers_to, payload_bytes, payload_digest and, if
    asked, payload (null for a revisit, which states its length in the HTTP head it kept).
    A response's length and digest come from the bytes read; a digest that differs from the
    record's own stops the job.
    """
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
    schema += ", payload binary" if with_payload else ""

    def number(text: str):
        digits = text.strip("<>").removeprefix(RECORD_ID)
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with filesystem.open_input_file(path) as source:
                    rows, held = [], 0
                    for headers, block in Package(source, source.size()).records():
                        kind, digest = headers["warc-type"], headers["warc-payload-digest"][5:]
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = len(payload)
                        if kind == "revisit":
                            payload, length = None, int(_headers(head)["content-length"])
                        elif payload_digest(payload) != digest:
                            raise ValueError(f"digest mismatch in {path}")
                        refers = headers.get("warc-refers-to", "")
                        row = (number(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, number(refers), length, digest)
                        rows.append((*row, payload) if with_payload else row)
                        held += len(payload or b"") if with_payload else 0
                        if len(rows) >= 2000 or held >= 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    spread = manifest.select("path").repartition(shuffle_width(manifest.sparkSession), "path")
    return spread.mapInArrow(read, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Writes a WARC record for every page (page_id, url, html) and reads all of them back.

    A null html is an empty payload, a null url a record without target. Repeated rows are
    repeated records. Other columns are ignored. No page: no package and no row.
    """
    folder = work_path(pages.sparkSession, "warc")
    return read_packages(write_packages(record_plan(pages, min_bytes), folder), folder, with_payload)
