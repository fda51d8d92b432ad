"""Token ids in files: static range asymmetric numeral systems.

One frequency table, counted over all ids, is shared by every block.  A block
holds up to ``BLOCK`` ids of whole documents and is coded apart from all others
by ``LANES`` interleaved coders: id number i belongs to lane ``i % LANES`` and
the lanes advance together as one vector.  A document longer than a block fills
several blocks of its own.

A file is a sequence of blocks, and a block is::

    magic 4s | ids u4 | fragments u4 | words u4 | crc of ids u4 | crc of body u4
    body: per fragment key i8, length u4, flags u1; lane states u8; words u4

all little-endian.  Flag 1: the document begins here; 2: it ends here; 4: its
key is null.  The crc of ids is that of the ids as unsigned 32-bit integers.

Next to the files stands the table of checkpoints.  A checkpoint is a place
where reading may start: one block of whole documents, or the run of blocks of
one long document.  Checkpoints are decoded in parallel, and the checksums of
each are tested.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.llm.common import spread
from hirelake.session import scratch_dir

BLOCK = 1 << 18
LANES = 1024
#: Ids after which a task begins another file.
FILE_IDS = 1 << 24
PRECISION = 20
LOWEST = 1 << 31
ALPHABET = 1 << 16
HEADER = struct.Struct("<4s5I")
FRAGMENT = np.dtype([("key", "<i8"), ("length", "<u4"), ("flags", "u1")])
MAGIC = b"rAN1"
BEGINS, ENDS, NULL_KEY = 1, 2, 4


class Coder:
    """Codes arrays of ids by a fixed table of frequencies that sum to 2**PRECISION."""

    def __init__(self, frequencies: np.ndarray):
        self.frequency = frequencies.astype(np.uint64)
        starts = np.cumsum(frequencies) - frequencies
        self.start = starts.astype(np.uint64)
        self.id_of_slot = np.repeat(np.arange(len(frequencies), dtype=np.uint16), frequencies)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lane states and words, in the order in which a reader needs them."""
        state = np.full(LANES, LOWEST, np.uint64)
        shift, width = np.uint64(PRECISION), np.uint64(32)
        # A state at or over frequency << full would leave its 63 bits.
        full = np.uint64(31 - PRECISION + 32)
        words = []
        for begin in range((len(ids) - 1) // LANES * LANES, -1, -LANES):
            row = ids[begin : begin + LANES]
            x = state[: len(row)]
            f = self.frequency[row]
            over = x >= f << full
            words.append(x[over].astype(np.uint32))
            x[over] >>= width
            quotient, rest = np.divmod(x, f)
            state[: len(row)] = (quotient << shift) + rest + self.start[row]
        return state, np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)

    def decode(self, n: int, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        ids = np.empty(n, np.uint16)
        state = state.copy()
        shift, width, slots = np.uint64(PRECISION), np.uint64(32), np.uint64((1 << PRECISION) - 1)
        at = 0
        for begin in range(0, n, LANES):
            x = state[: min(LANES, n - begin)]
            slot = x & slots
            row = self.id_of_slot[slot]
            x[:] = self.frequency[row] * (x >> shift) + slot - self.start[row]
            low = np.flatnonzero(x < LOWEST)
            x[low] = (x[low] << width) | words[at : at + len(low)]
            at += len(low)
            ids[begin : begin + len(row)] = row
        if at != len(words) or (state != LOWEST).any():
            raise ValueError("a block does not end where its coder began")
        return ids


def crc_of(ids: np.ndarray, before: int = 0) -> int:
    """Checksum of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes(), before)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**PRECISION, at least 1 for every id that occurs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    whole = 1 << PRECISION
    frequency = np.where(counts > 0, np.maximum(1, counts * whole // total), 0)
    # What rounding has added or left over goes to the commonest ids, in order.
    order = np.argsort(-counts, kind="stable")
    left = whole - int(frequency.sum())
    for i in order:
        change = left if left > 0 else max(left, 1 - int(frequency[i]))
        frequency[i] += change
        left -= change
        if not left:
            return frequency
    raise ValueError("more ids than slots")


def count_ids(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs; one row per id comes to the driver, 65,536 at most."""

    def run(batches):
        counts = np.zeros(ALPHABET, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                if ids.is_valid:
                    counts += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=ALPHABET)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    told = encoded.select("ids").mapInArrow(run, "id bigint, n bigint")
    counts = np.zeros(ALPHABET, np.int64)
    for row in told.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    return counts


def _block(coder: Coder, fragments: list[tuple], ids: np.ndarray) -> bytes:
    state, words = coder.encode(ids)
    body = (
        np.array(fragments, FRAGMENT).tobytes()
        + state.astype("<u8").tobytes()
        + words.astype("<u4").tobytes()
    )
    head = HEADER.pack(MAGIC, len(ids), len(fragments), len(words), crc_of(ids), zlib.crc32(body))
    return head + body


def _read_block(coder: Coder, source) -> tuple[np.ndarray, np.ndarray]:
    magic, n, n_fragments, n_words, ids_crc, body_crc = HEADER.unpack(source.read(HEADER.size))
    body = source.read(n_fragments * FRAGMENT.itemsize + 8 * LANES + 4 * n_words)
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise ValueError("a block is damaged")
    fragments = np.frombuffer(body, FRAGMENT, n_fragments)
    at = n_fragments * FRAGMENT.itemsize
    state = np.frombuffer(body, "<u8", LANES, at)
    ids = coder.decode(n, state, np.frombuffer(body, "<u4", n_words, at + 8 * LANES))
    if crc_of(ids) != ids_crc:
        raise ValueError("ids do not match their checksum")
    return fragments, ids


class _Files:
    """The files of one task, one after another, and a row for each checkpoint."""

    def __init__(self, folder: str, coder: Coder, part: int):
        self.system, self.root = FileSystem.from_uri(folder)
        self.folder, self.coder, self.part = folder, coder, part
        self.out, self.name, self.at, self.in_file, self.run = None, "", 0, 0, 0

    def add(self, blocks) -> tuple:
        """Write the blocks of one checkpoint."""
        if self.out is None or self.in_file >= FILE_IDS:
            self.close()
            # Another attempt of this task writes other files; only those of
            # the attempt that ends well are named by checkpoints.
            self.name = f"part-{self.part:06d}-{uuid.uuid4().hex}.rans"
            self.system.create_dir(self.root)
            self.out = self.system.open_output_stream(f"{self.root}/{self.name}")
            self.at = self.in_file = 0
        begin, n_ids, n_blocks = self.at, 0, 0
        for fragments, ids in blocks:
            data = _block(self.coder, fragments, ids)
            self.out.write(data)
            self.at += len(data)
            n_ids += len(ids)
            n_blocks += 1
        self.in_file += n_ids
        self.run += 1
        return (self.part, self.run, self.name, begin, n_blocks, n_ids)

    def close(self):
        if self.out is not None:
            self.out.close()


CHECKPOINT = "part int, run bigint, file string, at bigint, blocks int, ids bigint"


@dataclass
class Archive:
    """Files of coded ids: where they are, their checkpoints and their frequencies.

    The folder stands alone: ``table`` in it has the frequencies with a checksum,
    ``checkpoints``, written last, names the files that count.
    """

    folder: str
    checkpoints: DataFrame
    frequencies: np.ndarray


def _write_table(spark: SparkSession, folder: str, frequencies: np.ndarray) -> None:
    data = bytearray(np.asarray(frequencies, "<u4").tobytes())
    rows = spark.createDataFrame([(data, zlib.crc32(data))], "frequencies binary, crc32 bigint")
    rows.coalesce(1).write.parquet(f"{folder}/table")


def open_archive(spark: SparkSession, folder: str) -> Archive:
    """An archive that any session has written; its table must match its checksum."""
    row = spark.read.parquet(f"{folder}/table").first()
    if zlib.crc32(row.frequencies) != row.crc32:
        raise ValueError(f"{folder}: the frequency table is damaged")
    checkpoints = spark.read.schema(CHECKPOINT).parquet(f"{folder}/checkpoints")
    return Archive(folder, checkpoints, np.frombuffer(bytes(row.frequencies), "<u4").astype(np.int64))


def write_ids(encoded: DataFrame, key: str = "doc_id", folder: str | None = None) -> Archive:
    """Write ``ids`` (binary, little-endian unsigned 16-bit) in ascending order of ``key``.

    ``encoded`` is read three times, so land it first.  Null keys come first;
    rows of one key follow one another, in the order of their bytes.  Rows
    without ids keep their place.
    """
    spark = encoded.sparkSession
    folder = folder or scratch_dir(spark, "rans")
    frequencies = scaled(count_ids(encoded))

    def run(batches):
        files = _Files(folder, Coder(frequencies), TaskContext.get().partitionId())
        told: list[tuple] = []
        fragments: list[tuple] = []
        held: list[np.ndarray] = []
        n_held = 0

        def flush():
            nonlocal fragments, held, n_held
            if fragments:
                told.append(files.add([(fragments, np.concatenate(held))]))
            fragments, held, n_held = [], [], 0

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", "<u2")
                null = 0 if k is not None else NULL_KEY
                if n_held + len(ids) > BLOCK or len(fragments) >= BLOCK:
                    flush()
                if len(ids) > BLOCK:
                    cuts = range(0, len(ids), BLOCK)
                    told.append(
                        files.add(
                            (
                                [(k or 0, len(part), null | BEGINS * (c == 0) | ENDS * (c == cuts[-1]))],
                                part,
                            )
                            for c in cuts
                            for part in [ids[c : c + BLOCK]]
                        )
                    )
                else:
                    fragments.append((k or 0, len(ids), null | BEGINS | ENDS))
                    held.append(ids)
                    n_held += len(ids)
        flush()
        files.close()
        columns = list(zip(*told)) or [[]] * 6
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)],
            ["part", "run", "file", "at", "blocks", "ids"],
        )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        encoded.select(F.col(key).cast("bigint").alias("key"), "ids")
        .repartitionByRange(parts, "key")
        .sortWithinPartitions("key", "ids")
    )
    _write_table(spark, folder, frequencies)
    ordered.mapInArrow(run, CHECKPOINT).write.parquet(f"{folder}/checkpoints")
    return open_archive(spark, folder)


def with_starts(checkpoints: DataFrame) -> DataFrame:
    """Ids before each checkpoint: within its part, plus those of the parts before.

    The sum over parts has one row per writing task.
    """
    own = Window.partitionBy("part").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        checkpoints.groupBy("part")
        .agg(F.sum("ids").alias("ids"))
        .select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    )
    return (
        checkpoints.withColumn("start", F.coalesce(F.sum("ids").over(own), F.lit(0)))
        .join(parts, "part")
        .withColumn("start", F.col("start") + F.col("base"))
        .drop("base")
    )


def read_checkpoint(archive_folder: str, coder: Coder, file: str, at: int, blocks: int):
    """``(key, begins, ends, ids)`` of every fragment, in order."""
    system, root = FileSystem.from_uri(archive_folder)
    with system.open_input_file(f"{root}/{file}") as source:
        source.seek(at)
        for _ in range(blocks):
            fragments, ids = _read_block(coder, source)
            edges = [0, *np.cumsum(fragments["length"], dtype=np.int64).tolist()]
            for n, (key, _, flags) in enumerate(fragments.tolist()):
                key = None if flags & NULL_KEY else key
                yield key, bool(flags & BEGINS), bool(flags & ENDS), ids[edges[n] : edges[n + 1]]


def read_digests(archive: Archive, key: str = "doc_id") -> DataFrame:
    """Per document from the files: ``key``, ``start``, ``n_tokens``, ``ids_crc32``.

    A document of many blocks is summed up block by block.
    """
    folder, frequencies = archive.folder, archive.frequencies

    def run(batches):
        coder = Coder(frequencies)
        for batch in batches:
            for row in batch.to_pylist():
                rows, start, n, crc = [], row["start"], 0, 0
                for k, begins, ends, ids in read_checkpoint(
                    folder, coder, row["file"], row["at"], row["blocks"]
                ):
                    n, crc = (0, 0) if begins else (n, crc)
                    n, crc = n + len(ids), crc_of(ids, crc)
                    if ends:
                        rows.append((k, start, n, crc))
                        start += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)],
                    [key, "start", "n_tokens", "ids_crc32"],
                )

    todo = with_starts(archive.checkpoints).select("file", "at", "blocks", "start")
    return spread(todo, "file", "at").mapInArrow(run, f"{key} bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(archive: Archive, key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` (binary, as written) of every document."""
    folder, frequencies = archive.folder, archive.frequencies

    def run(batches):
        coder = Coder(frequencies)
        for batch in batches:
            for row in batch.to_pylist():
                keys, texts, held = [], [], []
                for k, _, ends, ids in read_checkpoint(
                    folder, coder, row["file"], row["at"], row["blocks"]
                ):
                    held.append(ids.astype("<u2").tobytes())
                    if ends:
                        keys.append(k)
                        texts.append(b"".join(held))
                        held = []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(texts, pa.binary())], [key, "ids"]
                )

    todo = archive.checkpoints.select("file", "at", "blocks")
    return spread(todo, "file", "at").mapInArrow(run, f"{key} bigint, ids binary")
