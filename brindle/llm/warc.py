"""WARC archives with a two-level capture index.

Records are gzip members of .warc.gz files. The index has a line for each record, sorted by the
reversed-host key of its URL and its id, in shards of compressed blocks; beside each shard stands a
sparse directory with the first key of each block. A lookup bisects the shards' first keys, then a
directory, then the lines of one block, and reads one range of one archive.

Files go through pyarrow's file systems to the folder that driver and executors share. A file counts
only if the table of captures names it, so a task that runs again leaves at most unused files.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, size_bytes

BLOCK_LINES = 256
LEVEL = 3
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
SHARD_BYTES = 256 << 20
#: An archive that has these bytes is closed and the next one begun, so a reader's memory is bounded.
ARCHIVE_BYTES = 64 << 20


def store(uri: str):
    """pyarrow's file system and path of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def reversed_host_key(url: str | None) -> str:
    """com,example)/path?query: lower-case host labels last to first, port kept, then path and query; '' for null."""
    if not url:
        return ""
    url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return f"){url}"
    key = ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, record: str) -> str:
    return f"{reversed_host_key(url)} {record}"


def record_bytes(record: str, kind: str, url: str | None, digest: str, payload: bytes, refers: str | None = None, refers_url: str | None = None) -> bytes:
    """A gzip member with one WARC record; a revisit has no payload in it."""
    clean = lambda u: "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in u)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:brindle:{record}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:brindle:{refers}>"]
        head += [f"WARC-Refers-To-Target-URI: {clean(refers_url)}"] if refers_url is not None else []
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers, names in lower case, and the HTTP body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def members(data: bytes, step: int = 65_536) -> Iterator[bytes]:
    """The contents of the gzip members of a file, one after another."""
    at, view = 0, memoryview(data)
    while at < len(data):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            part = view[at : at + step]
            out.append(d.decompress(part))
            at += len(part) - len(d.unused_data)
        yield b"".join(out)


class CaptureIndex:
    """Finds captures by key. shards: (first key, path) in order; a few directories are held at a time."""

    def __init__(self, fs, shards: list[tuple[str, str]], held: int = 8):
        self.fs, self.shards, self.firsts, self.held = fs, shards, [k for k, _ in shards], held
        self.directories: OrderedDict = OrderedDict()
        self.block: tuple = (None, [])

    def _read(self, path: str, offset: int, length: int) -> bytes:
        with self.fs.open_input_file(path) as f:
            return f.read_at(length, offset)

    def _directory(self, path: str) -> tuple[list, list]:
        if path not in self.directories:
            with self.fs.open_input_file(f"{path}.dir") as f:
                lines = [x.rsplit("\t", 2) for x in f.read().decode().split("\n")]
            self.directories[path] = [x[0] for x in lines], [(int(x[1]), int(x[2])) for x in lines]
            if len(self.directories) > self.held:
                self.directories.popitem(last=False)
        self.directories.move_to_end(path)
        return self.directories[path]

    def find(self, key: str) -> tuple[str, int, int] | None:
        """(archive, offset, length) of the capture with this key."""
        shard = bisect.bisect_right(self.firsts, key) - 1
        if shard < 0:
            return None
        path = self.shards[shard][1]
        firsts, ranges = self._directory(path)
        k = bisect.bisect_right(firsts, key) - 1
        if k < 0:
            return None
        if self.block[0] != (path, k):
            lines = zlib.decompress(self._read(path, *ranges[k]), 31).decode().split("\n")
            self.block = (path, k), [x.rsplit("\t", 3) for x in lines]
        lines = self.block[1]
        i = bisect.bisect_left(lines, key, key=lambda x: x[0])
        if i == len(lines) or lines[i][0] != key:
            return None
        return lines[i][1], int(lines[i][2]), int(lines[i][3])

    def payload(self, key: str) -> bytes:
        at = self.find(key)
        if at is None:
            raise KeyError(f"no capture {key}")
        return parse_record(zlib.decompress(self._read(*at), 31))[1]


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, list[tuple[str, str]]]:
    """Writes a record for each row and the capture index into folder (a URI); returns the captures and the shards.

    The payload is the column's UTF-8, null as empty. Of rows with equal payloads of at least LEAST_BYTES
    that with the smallest id is a response and those with other ids are revisits of it; smaller payloads
    and rows with a null id are responses. Repeated rows of one id are of one kind. Null URLs have the key ''.
    """
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    ids = src.select("id", "url", "digest", F.octet_length("payload").alias("n")).where(f"n >= {LEAST_BYTES}")
    first = ids.where("id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "url")).alias("first"), F.max("id").alias("last")).where("first.id < last").drop("last")
    again = ids.select("id", "digest").distinct().join(first, "digest").where("id <> first.id").select("id", "digest", "first")
    rows = src.join(again, ["id", "digest"], "left").select("id", "url", "payload", "digest", F.col("first.id").alias("first"), F.col("first.url").alias("first_url"))

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, root = store(folder)
        path, stream, at = "", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            for i, url, payload, digest, first, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    fs.create_dir(f"{root}/warc", recursive=True)
                    path, at = f"{root}/warc/{uuid.uuid4().hex}.warc.gz", 0
                    stream = fs.open_output_stream(path, compression=None)
                record = f"{'null' if i is None else format(i, '020d')}-{digest[:16]}"
                refers = None if first is None else f"{first:020d}-{digest[:16]}"
                data = record_bytes(record, "response" if first is None else "revisit", url, digest, payload.encode(), refers, first_url)
                stream.write(data)
                out.append((capture_key(url, record), path, at, len(data)))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    stream.close()
                    stream = None
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])
        if stream is not None:
            stream.close()

    captures = keep(rows.mapInArrow(write, "key string, file string, offset long, length long"))

    def index(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, root = store(folder)
        lines: list[str] = []
        directory: list[tuple[str, int, int]] = []
        state = {"stream": None, "at": 0}
        path = f"{root}/index/{uuid.uuid4().hex}.cdx.gz"

        def flush() -> None:
            if state["stream"] is None:
                fs.create_dir(f"{root}/index", recursive=True)
                state["stream"] = fs.open_output_stream(path, compression=None)
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = squeeze.compress("\n".join(lines).encode()) + squeeze.flush()
            directory.append((lines[0].rsplit("\t", 3)[0], state["at"], len(data)))
            state["stream"].write(data)
            state["at"] += len(data)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append("\t".join(map(str, row)))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if directory:
            state["stream"].close()
            with fs.open_output_stream(f"{path}.dir", compression=None) as f:
                f.write("\n".join("\t".join(map(str, x)) for x in directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([path])], names=["first", "path"])

    n = max(1, min(10_000, size_bytes(pages) // SHARD_BYTES))
    made = keep(captures.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(index, "first string, path string"))
    shards = sorted((r["first"], r["path"]) for r in made.collect())  # one row a shard
    return captures, shards


def read_archive(spark: SparkSession, folder: str, captures: DataFrame, shards: list[tuple[str, str]]) -> DataFrame:
    """(record, id, url, kind, refers_to, payload_bytes, digest, payload_sha256) of each record of the archives.

    Archives are read from end to end; what a revisit refers to is found by the capture index and read
    by its range. digest is the record's header, payload_sha256 is computed from the payload.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, _ = store(folder)
        index = CaptureIndex(fs, shards)
        names = ["record", "id", "url", "kind", "refers_to", "payload_bytes", "digest", "payload_sha256"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        number = lambda record: None if record.startswith("null") else int(record.rpartition("-")[0])
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    data = f.read()
                rows, later = [], []
                for raw in members(data):
                    h, body = parse_record(raw)
                    record, url = h["warc-record-id"][13:-1], h.get("warc-target-uri")
                    if h["warc-type"] == "revisit":
                        target = h["warc-refers-to"][13:-1]
                        later.append((capture_key(h.get("warc-refers-to-target-uri"), target), target, record, url, h["warc-payload-digest"][7:]))
                        continue
                    rows.append((record, number(record), url, "response", None, len(body), h["warc-payload-digest"][7:], hashlib.sha256(body).hexdigest()))
                    if len(rows) >= 10_000:
                        yield pack(rows)
                        rows = []
                last, size, digest = None, 0, ""
                for key, target, record, url, named in sorted(later, key=lambda x: (x[0], x[2])):
                    if key != last:
                        body = index.payload(key)
                        last, size, digest = key, len(body), hashlib.sha256(body).hexdigest()
                    rows.append((record, number(record), url, "revisit", number(target), size, named, digest))
                if rows:
                    yield pack(rows)

    files = captures.select("file").distinct()
    return files.repartition(max(1, files.count())).mapInArrow(read, "record string, id long, url string, kind string, refers_to long, payload_bytes long, digest string, payload_sha256 string")
