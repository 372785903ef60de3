"""WARC archives: pages out as records, records back in as a table of payload chunks."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.tables import settled
from strandline.session import scratch_path
from strandline.sources.stores import canonical, child, dealt_by_bytes, open_store

#: Bytes of one chunk row, and of one piece compressed or read at a time.
CHUNK = 256 * 1024
#: A file is closed and a new one begun beyond this size.
FILE_BYTES = 256 * 1024 * 1024
#: Payloads below this size are always stored, never referred to.
MIN_SHARED = 100

MANIFEST = "path string, records long, bytes long"
CHUNKS = (
    "record_id string, record_type string, page_id long, refers_to long, url string, declared_digest string, "
    "declared_bytes long, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, last boolean"
)


def deduplicated(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, n_bytes, refers_to``: the first page of an equal payload.

    Payloads are equal if length and SHA-256 are. Of each payload of at least
    ``MIN_SHARED`` bytes the smallest page_id is stored (``refers_to`` null), every other
    page refers to it. Rows that repeat that smallest id are stored too; a payload that has
    only null ids is stored each time.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("html"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
    )
    shared = (
        rows.where(F.col("n_bytes") >= MIN_SHARED)
        .groupBy("digest", "n_bytes")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "n_bytes", "first")
    )
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    return rows.join(shared, ["digest", "n_bytes"], "left").select(
        "page_id", "url", "html", "digest", "n_bytes", F.when(F.col("first").isNotNull() & other, F.col("first")).alias("refers_to")
    )


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(sha256(f'{page_id} {digest}'.encode()).hexdigest()[:32])}>"


def _record_head(page_id, url, digest, n_bytes, refers_to, date) -> tuple[bytes, bytes]:
    """WARC header and HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(http) + (n_bytes if refers_to is None else 0)),
        ("Payload-Length", n_bytes),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%", errors="replace")))
    if page_id is not None:
        fields.append(("Page-Id", page_id))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(refers_to, digest)),
            ("Refers-To-Page-Id", refers_to),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode(), http


def _pack(folder: str, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = open_store(folder)[0]
        path = out = None
        records = size = 0
        done = []
        for batch in batches:
            page, url, html, digest, n_bytes, refers = (batch.column(k) for k in range(6))
            if pa.types.is_large_string(html.type):
                html = html.cast(pa.large_binary())
            else:
                html = html.cast(pa.binary())
            for k in range(batch.num_rows):
                if out is None:
                    path = child(folder, f"pages-{uuid.uuid4().hex}.warc.gz")
                    out, records, size = system.open_output_stream(open_store(path)[1], compression=None), 0, 0
                n, refers_to = n_bytes[k].as_py(), refers[k].as_py()
                heads = _record_head(page[k].as_py(), url[k].as_py(), digest[k].as_py(), n, refers_to, date)
                # one gzip member per record; the payload goes through in pieces
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                parts = [b"".join(heads)]
                if refers_to is None:
                    view = memoryview(html[k].as_buffer())
                    parts += [view[a : a + CHUNK] for a in range(0, n, CHUNK)]
                for part in parts:
                    size += out.write(member.compress(part)) or 0
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                records += 1
                size = out.tell()
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            names=["path", "records", "bytes"],
        )

    return run


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write a record per page below ``folder`` (a shared URI); returns the manifest.

    Files are gzip with one member per record. A task names its files anew each time it
    runs, and the manifest, which is written once, lists the files of the tasks that
    ended; files of lost or repeated tasks are in no manifest and never read.
    """
    folder = canonical(folder)
    system, root = open_store(folder)
    system.create_dir(root, recursive=True)
    return settled(deduplicated(pages).mapInArrow(_pack(folder, date, level), MANIFEST), "warc-manifest")


class _Member:
    """Uncompressed bytes of the records of a file, read piece by piece."""

    def __init__(self, raw):
        self.raw, self.held, self.gzip, self.rest, self.end = raw, b"", None, b"", False

    def _more(self) -> bool:
        while not self.end:
            data = self.rest or self.raw.read(64 * 1024)
            self.rest = b""
            if not data:
                self.end = True
                return False
            if self.gzip is None:
                self.gzip = zlib.decompressobj(31)
            got = self.gzip.decompress(data, CHUNK)
            if self.gzip.eof:
                self.rest, self.gzip = self.gzip.unused_data, None
            else:
                self.rest = self.gzip.unconsumed_tail
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("archive ends within a header")
                return None
        head, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return head

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("archive ends within a record")
        part, self.held = self.held[:n], self.held[n:]
        return part


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def _records(stream) -> Iterator[tuple]:
    source = _Member(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        f = _fields(head)
        kind, left = f["WARC-Type"], int(f["Content-Length"])
        http = source.until(b"\r\n\r\n")
        left -= len(http)
        page, refers = f.get("Page-Id"), f.get("Refers-To-Page-Id")
        digest, declared = f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["Payload-Length"])
        fixed = (f["WARC-Record-ID"], kind, page and int(page), refers and int(refers), f.get("WARC-Target-URI"), digest, declared)
        running, done, number = sha256(), 0, 0
        while True:
            chunk = source.take(min(CHUNK, left - done))
            running.update(chunk)
            done += len(chunk)
            last = done == left
            if last and kind == "response" and (running.hexdigest() != digest or done != declared):
                raise ValueError(f"payload of {fixed[0]} is not what its header says")
            yield (*fixed, number, chunk, done, running.hexdigest(), last)
            number += 1
            if last:
                break
        if source.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {fixed[0]} is not closed")


def _unpack(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = open_store(path)
                held, size = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for row in _records(stream):
                        held.append(row)
                        size += len(row[8]) + 300
                        if size > 8 * 1024 * 1024:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    return run


_CHUNK_SCHEMA = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
        ("url", pa.string()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("chunk_no", pa.int64()),
        ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()),
    ]
)


def read_chunks(manifest: DataFrame) -> DataFrame:
    """The chunk table of archives: one row per record and chunk number.

    A payload is streamed in pieces of at most ``CHUNK`` bytes; no record is ever held
    whole. ``digest_so_far`` is the SHA-256 of the payload up to and with the chunk, so
    the row with ``last`` has that of the whole payload, which must be what the header
    says. An empty payload and a revisit have one row with an empty chunk. Files are
    packed into tasks by their bytes, large ones stand alone; damaged files raise an error.
    """
    paths = dealt_by_bytes(manifest.select("path", "bytes"), "path", "bytes").select("path")
    return paths.mapInArrow(_unpack(_CHUNK_SCHEMA), CHUNKS)


def page_records(chunks: DataFrame) -> DataFrame:
    """Per record ``page_id, payload_bytes, payload_digest, record_type, refers_to``, of the full payload."""
    return chunks.where("last").select(
        "page_id",
        F.col("declared_bytes").alias("payload_bytes"),
        F.when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages to archives in the shared folder and back to one row per record.

    Null html is an empty payload, a null url has no target, a null page_id stays null; an empty
    table makes no file and gives no row. Other columns are ignored.
    """
    folder = scratch_path(spark, "warc")
    return page_records(read_chunks(write_archives(pages, folder)))
