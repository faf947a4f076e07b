"""WARC archives: writing with revisits, a normaliser for whole-file gzip streams, and reading by offset index."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.llm.store import saved
from platewright.llm.words import utf8
from platewright.operators.stability import scratch_path, spread_out

# Payloads below this many bytes are always stored.
LEAST_SHARED = 100
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 18
GZIP = 31  # zlib's window setting for gzip framing
WHOLE_LEVEL, MEMBER_LEVEL = 1, 3
VERSION = b"WARC/1.1"
URL_SAFE = "!#$%&'()*+,/:;=?@[]~"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page")
CRAWLED = "2020-01-01T00:00:00Z"


def record_bytes(row: dict, date: str = CRAWLED) -> bytes:
    """One uncompressed WARC record of a page; a revisit carries headers only.

    Control characters and blanks of the address are percent-encoded, so no value can break a header. The page
    ids and the full payload's length travel in extension headers, left out where null.
    """
    page, digest, revisit = row["page_id"], row["digest"], row["revisit"]
    payload = b"" if revisit else row["payload"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["bytes"]
    name = f"{page}|{digest}"
    uri = quote(row["url"], safe=URL_SAFE) if row["url"] else f"urn:page:{page}"
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>",
        "WARC-Date": date,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "X-Payload-Length": row["bytes"],
        "X-Page-Id": page,
    }
    if revisit:
        first = row["first"]
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{first}|{digest}')}>"
        head["X-Refers-To-Page-Id"] = first
    head["Content-Length"] = len(http) + len(payload)
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"".join([VERSION, b"\r\n", lines.encode("ascii"), b"\r\n", http, payload, b"\r\n\r\n"])


def parse_headers(head: bytes) -> dict[str, str]:
    """Header block, version line first, by lower-case name."""
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    out = {}
    for line in lines:
        k, _, v = line.partition(b":")
        out[k.decode("ascii").strip().lower()] = v.decode("utf-8").strip()
    return out


class Inflated:
    """Reader over a gzip stream that inflates as it goes; consecutive members read as one stream."""

    def __init__(self, source):
        self.source, self.z, self.buffer = source, zlib.decompressobj(GZIP), bytearray()
        self.spare = b""

    def _more(self) -> bool:
        raw = self.spare or self.source.read(CHUNK)
        self.spare = b""
        if not raw:
            return False
        if self.z.eof:
            self.z = zlib.decompressobj(GZIP)
        self.buffer += self.z.decompress(raw)
        self.spare = self.z.unused_data
        return True

    def through(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the stream."""
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                if self.buffer.strip():
                    raise EOFError("archive ends inside a record")
                return None
        return self.take(found + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise EOFError("archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record of a gzip stream, inflated once."""
    stream = Inflated(source)
    while (head := stream.through(b"\r\n\r\n")) is not None:
        headers = parse_headers(head.lstrip(b"\r\n")[:-4])
        body = stream.take(int(headers["content-length"]) + 4)
        if body[-4:] != b"\r\n\r\n":
            raise ValueError("record is longer than its Content-Length")
        yield headers, head.lstrip(b"\r\n") + body


def member(raw: bytes, level: int = MEMBER_LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return z.compress(raw) + z.flush()


def normalise(source, target) -> list[dict]:
    """Rewrite a gzip archive with one member per record; the offset index as a list of entries."""
    index, at = [], 0
    for headers, raw in records(source):
        packed = member(raw)
        target.write(packed)
        index.append(
            {
                "offset": at,
                "length": len(packed),
                "type": headers["warc-type"],
                "uri": headers.get("warc-target-uri"),
                "digest": headers.get("warc-payload-digest"),
            }
        )
        at += len(packed)
    return index


def _own_name(folder: str, kind: str, k: int) -> str:
    """A file name that no other attempt of any task uses."""
    task = TaskContext.get()
    return f"{folder}/{kind}-{task.partitionId():06d}-{task.taskAttemptId()}-{k}"


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        done: list[tuple[str, int]] = []
        out = z = None
        used = n = 0

        def close():
            nonlocal out
            if out is not None:
                out.write(z.flush())
                out.close()
                done[-1] = (done[-1][0], n)
                out = None

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if out is None:
                    path = _own_name(root, "whole", len(done)) + ".warc.gz"
                    out, z = store.open_output_stream(path, compression=None), zlib.compressobj(WHOLE_LEVEL, zlib.DEFLATED, GZIP)
                    done.append((path, 0))
                    used = n = 0
                raw = record_bytes(row)
                out.write(z.compress(raw))
                used += len(raw)
                n += 1
                if used >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict(
            {"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([c for _, c in done], pa.int64())}
        )

    return run


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as whole-file gzip WARC archives; ``path, records`` per archive.

    Equal payloads of at least 100 bytes are stored once, with the smallest page id; the others are revisits of
    it. A null page id never names a class of equal payloads unless there is no other. Only archives
    of tasks that succeeded are listed, so lost or repeated tasks leave files that nobody reads. A task closes
    an archive after ``archive_bytes`` and starts the next.
    """
    rows = pages.select("page_id", "url", utf8(F.col("html")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    shared = (
        rows.where(F.col("bytes") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", "first")
    )
    marked = rows.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = marked.withColumn("revisit", revisit).withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))
    listed = marked.select("page_id", "url", "payload", "digest", "bytes", "first", "revisit").mapInArrow(
        _writer(folder, archive_bytes), "path string, records long"
    )
    return saved(listed, "archives")


def _normaliser(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            made = []
            for k, path in enumerate(batch.column("path").to_pylist()):
                name = _own_name(root, "members", k) + f"-{hashlib.md5(path.encode()).hexdigest()[:8]}.warc.gz"
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(name, compression=None) as target:
                    index = normalise(source, target)
                with store.open_output_stream(name + ".index.jsonl", compression=None) as side:
                    side.write("".join(json.dumps(e) + "\n" for e in index).encode())
                made.append((name, len(index)))
            yield pa.RecordBatch.from_pydict(
                {"path": pa.array([p for p, _ in made], pa.string()), "records": pa.array([c for _, c in made], pa.int64())}
            )

    return run


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every listed archive rewritten with one gzip member per record and a sidecar ``.index.jsonl``."""
    return saved(spread_out(archives, "path").mapInArrow(_normaliser(folder), "path string, records long"), "members")


READ_SCHEMA = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, html binary"
READ_ARROW = pa.schema(
    [("page_id", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.binary())]
)


def read_member(packed: bytes) -> dict:
    """One record from its gzip member; a response's digest and length are taken from its payload and checked."""
    raw = zlib.decompress(packed, GZIP)
    head, _, block = raw.partition(b"\r\n\r\n")
    headers = parse_headers(head)
    block = block[: int(headers["content-length"])]
    html = block.partition(b"\r\n\r\n")[2]
    revisit = headers["warc-type"] == "revisit"
    stated = headers["warc-payload-digest"].partition(":")[2]
    length = int(headers["x-payload-length"])
    if not revisit and (hashlib.sha256(html).hexdigest() != stated or len(html) != length):
        raise ValueError("payload does not match its digest")
    number = lambda name: int(headers[name]) if name in headers else None
    return {
        "page_id": number("x-page-id"), "uri": headers.get("warc-target-uri"), "payload_bytes": length,
        "payload_digest": stated, "record_type": headers["warc-type"], "refers_to": number("x-refers-to-page-id"),
        "html": None if revisit else html,
    }


def _reader(folder: str, wanted: list[str]):
    schema = pa.schema([READ_ARROW.field(n) for n in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path + ".index.jsonl", compression=None) as side:
                    index = [json.loads(line) for line in side.read().splitlines()]
                with store.open_input_file(path) as archive:
                    held, used = [], 0
                    for e in index:
                        row = read_member(archive.read_at(e["length"], e["offset"]))
                        held.append({n: row[n] for n in wanted})
                        used += e["length"]
                        if used > CHUNK * 16:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, used = [], 0
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def read_archives(members: DataFrame, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of normalised archives, each record fetched by its entry in the offset index.

    ``html`` is the payload of a response and null for a revisit.
    """
    wanted = columns or READ_ARROW.names
    kinds = dict(f.split(" ") for f in READ_SCHEMA.split(", "))
    schema = ", ".join(f"{n} {kinds[n]}" for n in wanted)
    return spread_out(members, "path").mapInArrow(_reader(folder, wanted), schema)


def round_trip(pages: DataFrame, folder: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Write, normalise and read back ``pages(page_id, url, html)``; one row per page.

    Null html is an empty payload; a null address becomes ``urn:page:<id>``; null ids stay null. Rows
    that repeat the smallest id of equal payloads are all responses. An empty table gives no rows; further
    columns are ignored. Files go under ``folder``, by default a fresh one under ``spark.checkpoint.dir``, which
    must be reachable from every executor through pyarrow's file systems (file, hdfs, s3, gs).
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    archives = write_archives(pages, folder)
    return read_archives(normalise_archives(archives, folder), folder, columns)
