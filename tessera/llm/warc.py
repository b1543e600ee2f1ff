"""WARC archives with a two-level capture index.

Writing: pages become gzipped WARC records, one gzip member a record, in archive
files of the shared folder. Of records with the same payload (of at least
``min_bytes`` bytes) one is the response; the others are revisits that name it.

Index: a line a capture, keyed by the URL with its host reversed, sorted over all
archives, in compressed blocks of ``block_lines`` lines; a sparse directory has
the first key and the place of each block. A lookup finds its block in the
directory (a sorted table, of which statistics skip most), reads that range of
an index file, bisects its lines, and reads one range of an archive for each
capture. A full read goes block by block the same way.

Files are written under a name of their own and renamed when complete, so a task
that is lost or run twice leaves no half archive: the rows that name the files
come from the attempt that counted.

Defined results: a null page is an empty payload; rows with the same id are
records each of their own, and the revisit of equal payloads with the largest id
goes by the row that sorts last; a null URL has the empty key; an empty table
writes nothing and reads nothing; extra columns are not kept.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path, written

LEVEL = 1
BLOCK_LINES = 1000
#: Records of up to so many bytes before compression share an archive file; a task starts another beyond.
ARCHIVE_BYTES = 1 << 30

CAPTURE = "key string, page_id long, file string, offset long, length long, digest string, payload_bytes long, kind string"
DIRECTORY = "key string, file string, offset long, length long, lines long"


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, then the port and the path with its query, lower case; no scheme, no fragment, no `www`."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return re.sub(r"[\x00-\x20\x7f]|\s", "%20", url.lower())
    host = re.sub(r"^www\d*\.", "", host)
    path = (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")
    return re.sub(r"[\x00-\x20\x7f]|\s", "%20", f"{','.join(reversed(host.split('.')))}{f':{port}' if port and port not in (80, 443) else ''}){path}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record: headers, and for a response the payload as well."""
    body = payload if kind == "response" else b""
    safe = re.sub(r"[\r\n]", " ", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:tessera:page:{page_id}>", f"WARC-Target-URI: {safe}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:tessera:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit its header")
    return fields, rest[:size]


def pack_member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _File:
    """A file that appears under its name when it is complete."""

    def __init__(self, root: str, name: str) -> None:
        self.fs, self.root = store(root)
        self.fs.create_dir(self.root, recursive=True)
        self.name = name
        self.out = self.fs.open_output_stream(f"{self.root}/.{name}.part", compression=None)
        self.size = 0

    def append(self, data: bytes) -> tuple[int, int]:
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at, len(data)

    def done(self) -> None:
        self.out.close()
        self.fs.move(f"{self.root}/.{self.name}.part", f"{self.root}/{self.name}")


class _Reader:
    """Range reads from files of one folder; the last one stays open."""

    def __init__(self, root: str) -> None:
        self.fs, self.root = store(root)
        self.name, self.file = "", None

    def range(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file:
                self.file.close()
            self.file, self.name = self.fs.open_input_file(f"{self.root}/{name}"), name
        self.file.seek(offset)
        return self.file.read(length)


@dataclass(frozen=True)
class Archive:
    """Where archives and index are, and the directory of the index (a row a block)."""

    root: str
    directory: DataFrame

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """All captures of a URL: its block by the directory, its lines by bisection, its records by their ranges."""
        key = url_key(url)
        # captures of a key may go on over several blocks: from the last block that begins before the key to the last that begins with it
        before = self.directory.where(F.col("key") < key).agg(F.max("key")).first()[0]
        blocks = self.directory.where((F.col("key") == key) | (F.col("key") == F.lit(before))).collect()
        index, archive, out = _Reader(self.root), _Reader(self.root), []
        for b in sorted(blocks, key=lambda b: (b.key, b.file, b.offset)):
            lines = zlib.decompress(index.range(b.file, b.offset, b.length), 31).decode().split("\n")[:-1]
            i = bisect.bisect_left(lines, key + " ")
            while i < len(lines) and lines[i].startswith(key + " "):
                c = json.loads(lines[i].split(" ", 1)[1])
                out.append(parse(zlib.decompress(archive.range(c["file"], c["offset"], c["length"]), 31)))
                i += 1
        return out


def marked(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Each page's payload with its digest, and which record it revisits.

    Digests are grouped with partial sums, so many copies of a page are one row a
    task; the join that brings the winner back may be split where a digest is common.
    Rows that repeat id, address and payload are merged before it, and come out as
    many as they were; one of them at most is the response. A null id is smaller than
    all others, and a revisit of it refers to nothing.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long")).withColumn("tie", F.xxhash64("url"))
    same = ["page_id", "url", "sha", "size", "tie"]
    if base.groupBy(same).count().where("count > 1").take(1):
        base = base.groupBy(same).agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("times"))
    else:
        base = base.withColumn("times", F.lit(1).cast("long"))
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("k"), "tie")
    groups = base.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.max(rank).alias("best"), F.sum("times").alias("n"))
    groups = groups.where("n > 1").select(F.col("sha").alias("other"), "best")
    found = base.join(groups, F.col("sha") == F.col("other"), "left").withColumn("copy", F.explode(F.expr("sequence(1L, times)")))
    revisit = F.col("best").isNotNull() & (~rank.eqNullSafe(F.col("best")) | (F.col("copy") > 1))
    return found.select("page_id", "url", "payload", F.when(revisit, F.col("best.k")).alias("refers_to"), F.when(revisit, "revisit").otherwise("response").alias("kind"))


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """Write the records; a row for each capture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, names = None, [f.split()[0] for f in CAPTURE.split(", ")]
        for batch in batches:
            rows = []
            for page_id, url, payload, refers_to, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or out.size > ARCHIVE_BYTES:
                    if out is not None:
                        out.done()
                    out = _File(root, f"{uuid.uuid4().hex}.warc.gz")
                sha = digest(payload)
                rows.append((url_key(url), page_id, out.name, *out.append(pack_member(record(kind, page_id, url, payload, sha, refers_to))), sha, len(payload), kind))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if out is not None:
            out.done()

    return written(marked(pages, min_bytes).mapInArrow(run, CAPTURE), "captures")


def write_index(captures: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures by key over all tasks, write compressed blocks, and return the directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, lines, first = None, [], [], ""

        def flush() -> None:
            nonlocal out
            if lines:
                out = out or _File(root, f"{uuid.uuid4().hex}.cdx.gz")
                rows.append((first, out.name, *out.append(pack_member("".join(lines).encode())), len(lines)))
                lines.clear()

        for batch in batches:
            for c in batch.to_pylist():
                if not lines:
                    first = c["key"]
                lines.append(f"{c.pop('key')} {json.dumps(c)}\n")
                if len(lines) >= block_lines:
                    flush()
        flush()
        if out is not None:
            out.done()
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in DIRECTORY.split(", ")])

    # the id breaks up a key with very many captures; blocks of one key may lie in several tasks
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return written(ordered.mapInArrow(run, DIRECTORY), "directory")


def archive(pages: DataFrame, root: str | None = None, min_bytes: int = 0) -> Archive:
    root = root or new_path(pages.sparkSession, "warc")
    return Archive(root, write_index(write_archives(pages, root, min_bytes), root))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _page(urn: str | None) -> int | None:
    value = urn.rsplit(":", 1)[1].rstrip(">") if urn else "None"
    return None if value == "None" else int(value)


def read_back(found: Archive, per_task: int = 4) -> DataFrame:
    """Every record, read through the index: blocks by their ranges, records by theirs. A response's digest is that of what was read."""
    root = found.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, records = _Reader(root), _Reader(root)
        for batch in batches:
            for block in batch.to_pylist():
                captures = [json.loads(x.split(" ", 1)[1]) for x in zlib.decompress(index.range(block["file"], block["offset"], block["length"]), 31).decode().split("\n")[:-1]]
                rows = []
                for c in sorted(captures, key=lambda c: (c["file"], c["offset"])):
                    fields, body = parse(zlib.decompress(records.range(c["file"], c["offset"], c["length"]), 31))
                    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(body) != said:
                        raise ValueError(f"a payload in {c['file']} at {c['offset']} does not have its digest")
                    rows.append((_page(fields["WARC-Record-ID"]), len(body) if kind == "response" else int(fields["X-Payload-Length"]), said, kind, _page(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in READ.split(", ")])

    n = max(1, int(found.directory.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return found.directory.repartition(n, "file", "offset").mapInArrow(run, READ)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))


QUERIES = {"op10_warc": op10_warc}
