"""WARC archives with a two-level capture index.

Writing: every task appends its pages to one archive of its own, a gzip member
per record, under a name no other attempt shares; the index rows of committed
attempts are what counts.  A payload that occurs more than once is stored once,
under its largest page id; the others are revisit records.

Index: captures are ordered by reversed-host URL key across all tasks, cut into
blocks of some hundred lines, each compressed by itself, with a sparse
directory of the blocks' first keys behind them.  The top level is one row per
index part - their number follows the captures.  A look-up finds the part, the
block and the line by three binary searches and then reads just the byte range
of the record.

Files are opened through the file system their address names, so the shared
folder may be a mounted path or an object store.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, land, shared_dir

#: Parts of an index at least, and captures of a part.
PARTS, PART_CAPTURES = 24, 50_000
#: Lines of an index block.
BLOCK_LINES = 256
#: Archives a reading task keeps open.
OPEN_FILES = 32
RAW = "key string, page_id long, file string, offset long, length long"
NO_PAGE = -(1 << 63)


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host, then path and query, lower-cased; ``)`` alone for a missing one."""
    if not url:
        return ")"
    try:
        parts = urllib.parse.urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return ")" + url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")"
    return key + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has no payload."""
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Target-URI: " + urllib.parse.quote(url or "", safe=";/?:@&=+$,#%!*'()~[]"),
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head[4:4] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and body of a gzip member that holds one record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record has a wrong length")
    return fields, rest[:n]


def _page_of(name: str) -> int | None:
    name = name[len("<urn:page:") : -1]
    return None if name == "none" else int(name)


def _open(address: str, mode: str):
    if "://" not in address and not address.startswith("file:"):
        address = "file://" + address
    if address.startswith("file:/") and not address.startswith("file://"):
        address = "file://" + address[len("file:") :]
    files, path = pafs.FileSystem.from_uri(address)
    if mode == "w":
        if isinstance(files, pafs.LocalFileSystem):
            files.create_dir(path.rpartition("/")[0], recursive=True)
        return files.open_output_stream(path, compression=None)
    return files.open_input_file(path)


@dataclass
class Archive:
    """Where an archive lies: ``folder`` of the files, and the table of its index parts."""

    spark: SparkSession
    folder: str
    parts: str


def plan(pages: DataFrame) -> DataFrame:
    """``pages`` with payload, digest and what each becomes.  Equal payloads meet by digest; the page with the largest id stores it."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    largest = rows.groupBy(F.col("digest").alias("_d")).agg(F.max("page_id").alias("holder"))
    return rows.join(largest, F.col("digest") == F.col("_d")).drop("_d")


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{folder}/warc/{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                found: dict[str, list] = {k: [] for k in ("key", "page_id", "file", "offset", "length")}
                for page_id, url, payload, digest, holder in zip(*(batch.column(i) for i in range(5))):
                    page_id, url, holder = page_id.as_py(), url.as_py(), holder.as_py()
                    text = base64.b32encode(digest.as_py()).decode()
                    member = gzip.compress(record(page_id, url, payload.as_py(), text, holder, page_id != holder), 6, mtime=0)
                    if out is None:
                        out = _open(name, "w")
                    out.write(member)
                    for k, v in zip(found, (url_key(url), page_id, name, at, len(member))):
                        found[k].append(v)
                    at += len(member)
                types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), types)], list(found))
        finally:
            if out is not None:
                out.close()

    return run


def _pack(lines: list[list]) -> bytes:
    return zlib.compress(json.dumps(lines, ensure_ascii=False).encode(), 6)


def _unpack(data: bytes) -> list[list]:
    return json.loads(zlib.decompress(data))


def _indexer(folder: str):
    """Sorted captures of a task to one index part: blocks, then their directory, then where the directory lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, lines, directory, last = None, 0, [], [], None
        name = f"{folder}/index/{uuid.uuid4().hex}.cdx"

        def flush() -> int:
            data = _pack(lines)
            out.write(data)
            directory.append([lines[0][:2], at, len(data)])
            return at + len(data)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, page_id, *rest = row
                last = [key, NO_PAGE if page_id is None else page_id]
                out = out or _open(name, "w")
                lines.append([*last, *rest])
                if len(lines) == BLOCK_LINES:
                    at, lines = flush(), []
        if out is not None:
            if lines:
                at = flush()
            out.write(_pack(directory))
            out.write(struct.pack(">Q", at))
            out.close()
            first = directory[0][0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in (name, first[0], first[1], at)], ["file", "first_key", "first_page", "directory_at"]
            )

    return run


def write(pages: DataFrame, parts: int = PARTS, captures_per_part: int = PART_CAPTURES) -> Archive:
    """Write a record per row of ``pages`` (``page_id, url, html``; other columns are ignored) and index them.

    The index has ``parts`` parts at least, and more where one would hold more than ``captures_per_part`` captures, so
    what a reader unpacks of a directory does not grow with the archive.

    A missing ``html`` is an empty payload.  A missing ``page_id`` never holds a payload others refer to unless all its
    copies lack an id; rows that repeat the largest id of a payload are all responses.  No rows: no files.
    """
    spark = pages.sparkSession
    importable(spark)
    folder = shared_dir(spark)
    # Landed, so that the index sees the files of exactly one attempt per task.
    captures = land(plan(pages).mapInArrow(_writer(folder), RAW))
    parts = max(parts, -(-captures.count() // captures_per_part))
    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    schema = "file string, first_key string, first_page long, directory_at long"
    made = ordered.mapInArrow(_indexer(folder), schema)
    made.write.parquet(f"{folder}/parts")
    return Archive(spark, folder, f"{folder}/parts")


class Finder:
    """Binary searches over index parts, blocks and lines, with the files it has open."""

    def __init__(self, parts: list[tuple[list, str, int]]):
        self.parts = sorted(parts)
        self.firsts = [p[0] for p in self.parts]
        self.open: dict[str, pa.NativeFile] = {}
        self.directories: dict[str, list] = {}
        self.block: tuple = (None, None)

    def read(self, name: str, at: int, n: int | None = None) -> bytes:
        file = self.open.get(name)
        if file is None:
            if len(self.open) >= OPEN_FILES:
                self.open.pop(next(iter(self.open))).close()
            file = self.open[name] = _open(name, "r")
        return file.read_at((file.size() if n is None else at + n) - at, at)

    def directory(self, part: int) -> list:
        _, name, at = self.parts[part]
        if name not in self.directories:
            self.directories.clear()
            self.directories[name] = _unpack(self.read(name, at)[:-8])
        return self.directories[name]

    def lines(self, part: int, block: int) -> list:
        if self.block[0] != (part, block):
            _, at, n = self.directory(part)[block]
            self.block = (part, block), _unpack(self.read(self.parts[part][1], at, n))
        return self.block[1]

    def find(self, key: str, page: int) -> list:
        """All captures of a key and page, from the first block that can hold one."""
        want, found = [key, page], []
        part = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while part < len(self.parts) and self.firsts[part] <= want:
            firsts = [d[0] for d in self.directory(part)]
            block = max(0, bisect.bisect_left(firsts, want) - 1)
            while block < len(firsts) and firsts[block] <= want:
                lines = self.lines(part, block)
                at = bisect.bisect_left(lines, want)
                while at < len(lines) and lines[at][:2] == want:
                    found.append(lines[at])
                    at += 1
                block += 1
            part += 1
        return found


def _reader(parts: list[tuple[list, str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, cursor = Finder(parts), {}
        for batch in batches:
            rows = []
            for key, page_id in zip(*(c.to_pylist() for c in batch.columns)):
                want = (key, NO_PAGE if page_id is None else page_id)
                hits = finder.find(*want)
                if not hits:
                    raise KeyError(f"{want} is not in the index")
                # The n-th asking for a key gets its n-th capture: repeated rows are repeated records.
                n = cursor[want] = cursor.get(want, -1) + 1 if len(hits) > 1 else 0
                _, _, file, offset, length = hits[n % len(hits)]
                fields, body = parse(finder.read(file, offset, length))
                digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                if kind == "response" and payload_digest(body) != digest:
                    raise ValueError(f"page {page_id}: payload and digest differ")
                refers = _page_of(fields["warc-refers-to"]) if kind == "revisit" else None
                rows.append((_page_of(fields["warc-record-id"]), len(body), digest, kind, refers, body))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["page_id", "body_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["key", "page_id"]
        )


def read(archive: Archive, wanted: DataFrame, payload: bool = False) -> DataFrame:
    """Records of ``wanted`` (``url, page_id``), found through the index and read by byte range.

    Columns ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and, if asked for, ``payload``; the
    size (and payload) of a revisit is that of the response it refers to.  An unknown key is an error.
    """
    spark = archive.spark
    # One row per index part, see ``write``.
    parts = [
        ([r["first_key"], r["first_page"]], r["file"], r["directory_at"]) for r in spark.read.parquet(archive.parts).collect()
    ]
    schema = "page_id long, body_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    width = max(1, len(parts))
    # In key order, so that a task meets each block once.
    keys = wanted.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(_keys, "key string, page_id long")
    asked = keys.repartitionByRange(width, "key", "page_id").sortWithinPartitions("key", "page_id")
    got = asked.mapInArrow(_reader(parts), schema)
    if not payload:
        got = got.drop("payload")
    got = land(got)
    kept = ["payload"] if payload else []
    held = got.where("record_type = 'response'").groupBy(F.col("page_id").alias("_held"))
    held = held.agg(F.first("body_bytes").alias("_bytes"), *[F.first(c).alias("_" + c) for c in kept])
    full = got.join(held, F.col("refers_to") == F.col("_held"), "left")
    return full.select(
        "page_id",
        F.coalesce("_bytes", "body_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
        *[F.coalesce("_" + c, c).alias(c) for c in kept],
    )
