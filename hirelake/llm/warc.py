"""WARC archives as a chunked record table.

A payload is a run of chunk rows::

    page_id, url, record_type, refers_to, payload_digest, payload_bytes,
    chunk_no, chunk, digest_so_far, last

in order and within one task.  Writer and reader handle one chunk at a time and
carry a running SHA-1 from chunk to chunk, so neither holds a whole record.
``last`` marks the row whose running digest is that of the full payload.

Records are gzip members of their own.  A response is an HTTP message around
the payload; a revisit has the head alone and names the page it repeats.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import landed, spread
from hirelake.session import scratch_dir

CHUNK = 1 << 16
#: Compressed bytes after which a task begins another file.
FILE_BYTES = 1 << 26
#: Payloads below this size are never revisits.
LEAST_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of an Arrow batch of chunks.
BATCH = 64

CHUNKS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("chunk_no", pa.int64()),
        ("chunk", pa.binary()),
        ("digest_so_far", pa.string()),
        ("last", pa.bool_()),
    ]
)
CHUNKS_DDL = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string,"
    " payload_bytes bigint, chunk_no bigint, chunk binary, digest_so_far string, last boolean"
)


def described(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``html``, ``payload_digest``, ``payload_bytes``; null html: empty."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.sha1(html).alias("payload_digest"),
        F.octet_length(html).cast("bigint").alias("payload_bytes"),
    )


def with_types(pages: DataFrame) -> DataFrame:
    """:func:`described` rows with ``record_type`` and ``refers_to``.

    Of equal payloads of at least ``LEAST_BYTES`` the largest page_id is the
    response (null counts as smallest; repeated rows of that page are all
    responses); the others revisit it.  Groups are found on digests alone and
    pre-aggregated; payloads meet only the rows of revisits, by page.
    """
    rows = described(pages)
    slim = rows.filter(F.col("payload_bytes") >= LEAST_BYTES).select("page_id", "payload_digest")
    response = slim.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"))
    revisits = (
        slim.join(response, "payload_digest")
        .filter(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "refers_to")
        .distinct()
    )
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d"))
    return rows.join(revisits, same, "left").select(
        "page_id",
        "url",
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        "refers_to",
        "payload_digest",
        "payload_bytes",
        "html",
    )


def _batches(rows: Iterator[tuple], names: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([CHUNKS.field(n) for n in names]) if names else CHUNKS
    held: list[tuple] = []

    def made():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema
        )

    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield made()
            held = []
    if held:
        yield made()


def _cut(payload: pa.Buffer, head: tuple) -> Iterator[tuple]:
    """Chunk rows of a payload, which is only looked at, not copied."""
    running = hashlib.sha1()
    view = memoryview(payload)
    starts = range(0, max(1, len(view)), CHUNK)
    for n, start in enumerate(starts):
        part = view[start : start + CHUNK]
        running.update(part)
        yield (*head, n, bytes(part), running.hexdigest(), start == starts[-1])


def to_chunks(typed: DataFrame) -> DataFrame:
    """The chunk table of :func:`with_types` rows; a revisit is one empty chunk."""

    def rows(batches):
        for batch in batches:
            heads = zip(*(batch.column(i).to_pylist() for i in range(6)))
            for head, html in zip(heads, batch.column(6)):
                buffer = html.as_buffer() if head[2] == "response" else pa.py_buffer(b"")
                yield from _cut(buffer, head)

    return typed.mapInArrow(lambda batches: _batches(rows(batches)), CHUNKS_DDL)


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str):
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _heads(row: dict) -> tuple[bytes, bytes]:
    """Record head and HTTP head."""
    response = row["record_type"] == "response"
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", _name(row["page_id"])),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(http) + row["payload_bytes"] * response),
    ]
    if row["url"] is not None:
        safe = row["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
        fields.append(("WARC-Target-URI", safe))
    if not response:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(row["refers_to"]))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return text.encode(), http.encode()


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows as archives; the names of the files (``file``, ``records``).

    A task writes files of its own.  A repeated task writes other files, and
    only those of the attempt that ended are named.
    """

    def run(batches):
        system, root = FileSystem.from_uri(folder)
        system.create_dir(root)
        part = TaskContext.get().partitionId()
        files: list[list] = []
        out, size, packer, running = None, 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is None or size >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        files.append([f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0])
                        out, size = system.open_output_stream(f"{root}/{files[-1][0]}"), 0
                    packer, running = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    files[-1][1] += 1
                    head, http = _heads(row)
                    size += out.write(packer.compress(head + http)) or 0
                running.update(row["chunk"])
                data = packer.compress(row["chunk"])
                if row["last"]:
                    if row["record_type"] == "response" and running.hexdigest() != row["payload_digest"]:
                        raise ValueError(f"page {row['page_id']}: chunks do not match the digest")
                    data += packer.compress(b"\r\n\r\n") + packer.flush()
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64())],
            ["file", "records"],
        )

    return landed(chunks.mapInArrow(run, "file string, records bigint"), "warc-files")


class _Stream:
    """The bytes of a gzip file of many members, a little at a time."""

    def __init__(self, source):
        self.source, self.unpacker = source, zlib.decompressobj(31)
        self.held, self.packed = bytearray(), b""

    def _more(self) -> bool:
        if self.unpacker.eof:
            self.packed, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
        if not self.packed:
            self.packed = self.source.read(CHUNK)
            if not self.packed:
                return False
        self.held += self.unpacker.decompress(self.packed, CHUNK)
        self.packed = self.unpacker.unconsumed_tail
        return True

    def line(self) -> bytes | None:
        at = 0
        while (end := self.held.find(b"\r\n", at)) < 0:
            at = max(0, len(self.held) - 1)
            if not self._more():
                return None
        found = bytes(self.held[:end])
        del self.held[: end + 2]
        return found

    def fields(self) -> dict[str, str]:
        out = {}
        while found := self.line():
            name, _, value = found.decode().partition(":")
            out[name.strip()] = value.strip()
        return out

    def some(self, most: int) -> bytes:
        while len(self.held) < most and self._more():
            pass
        found = bytes(self.held[:most])
        del self.held[:most]
        return found


def _read(source) -> Iterator[tuple]:
    """Chunk rows of an archive."""
    stream = _Stream(source)
    while (start := stream.line()) is not None:
        if start != b"WARC/1.1":
            raise ValueError("not the start of a record")
        head = stream.fields()
        stream.line()  # the HTTP status
        http = stream.fields()
        response = head["WARC-Type"] == "response"
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        n_bytes = int(http["Content-Length"])
        url = head.get("WARC-Target-URI")
        if url is not None:
            url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        refers_to = None if response else _page(head["WARC-Refers-To"])
        told = (_page(head["WARC-Record-ID"]), url, head["WARC-Type"], refers_to, digest, n_bytes)
        running, left, n = hashlib.sha1(), n_bytes * response, 0
        while True:
            part = stream.some(min(left, CHUNK))
            running.update(part)
            left -= len(part)
            if left and not part:
                raise ValueError("a record ends early")
            yield (*told, n, part, running.hexdigest(), not left)
            n += 1
            if not left:
                break
        if response and running.hexdigest() != digest:
            raise ValueError(f"{head['WARC-Record-ID']}: the payload does not match its digest")
        if stream.some(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its head says")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """The chunk table of archives; one task reads a file from start to end."""

    def rows(batches):
        system, root = FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{file}") as source:
                    yield from _read(source)

    return spread(files.select("file"), "file").mapInArrow(
        lambda batches: _batches(rows(batches)), CHUNKS_DDL
    )


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """One row per record: the last chunk row without the chunk."""
    names = [n for n in CHUNKS.names if n != "chunk"]
    fields = ", ".join(x.strip() for x in CHUNKS_DDL.split(",") if x.split()[0] != "chunk")
    keep = [CHUNKS.names.index(n) for n in names]

    def rows(batches):
        system, root = FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{file}") as source:
                    for row in _read(source):
                        if row[-1]:
                            yield tuple(row[i] for i in keep)

    return spread(files.select("file"), "file").mapInArrow(
        lambda batches: _batches(rows(batches), names), fields
    )


def write_pages(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Pages (page_id, url, html) as archives: their files and their folder."""
    folder = folder or scratch_dir(pages.sparkSession, "warc")
    return write_archives(to_chunks(with_types(pages)), folder), folder
