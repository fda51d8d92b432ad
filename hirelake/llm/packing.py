"""Packing documents into sequences of a fixed length by bin completion.

Documents longer than a sequence are cut into full pieces and a rest.  Full
pieces are sequences by themselves.  The others are dealt into groups of about
``GROUP`` by a hash, and each group is solved by itself, so a group costs at
most a part of one sequence.

Within a group, branch and bound over sequences: a node takes the largest piece
left and branches over the undominated fillings of the room beside it, least
waste first.  A branch is cut when the waste so far, which can only grow,
exceeds what the best solution known (the incumbent; best-fit decreasing to
begin with) leaves for one sequence fewer.  The search ends when the incumbent
meets the bound of the total length, or after ``NODES`` nodes, which bounds
time and drops no piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import landed, spread

LENGTH = 4096
GROUP = 8192
NODES = 20_000
#: Fillings tried at a node.
BRANCHES = 8


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Best-fit decreasing: places of ``sizes`` by sequence."""
    rooms: list[tuple[int, int]] = []  # (room, sequence), ascending
    out: list[list[int]] = []
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = bisect_left(rooms, (sizes[at], -1))
        if n == len(rooms):
            out.append([at])
            insort(rooms, (length - sizes[at], len(out) - 1))
        else:
            room, sequence = rooms.pop(n)
            out[sequence].append(at)
            insort(rooms, (room - sizes[at], sequence))
    return out


class _Left:
    """A multiset of sizes with the distinct ones in order."""

    def __init__(self, sizes, length: int):
        # Plain integers: the search reads and changes single counts millions of times.
        self.count = np.bincount(sizes, minlength=length + 1).tolist()
        self.sizes = [size for size, n in enumerate(self.count) if n]

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.sizes[bisect_left(self.sizes, size)]

    def put(self, size: int) -> None:
        if not self.count[size]:
            insort(self.sizes, size)
        self.count[size] += 1

    def at_most(self, size: int) -> int:
        """The largest size not over ``size``; 0 if there is none."""
        n = bisect_left(self.sizes, size + 1)
        return self.sizes[n - 1] if n else 0


def fillings(left: _Left, room: int, limit: int = BRANCHES) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room``, least waste first.

    A filling starts with some size and goes on with the largest that fits, or
    with the largest that leaves room for exactly the next.  Another filling
    dominates it when it holds one piece as large as all of these together:
    such are left out.
    """
    single = left.at_most(room)
    if not single:
        return [()]
    found = {(single,): single}
    sizes, count = left.sizes, left.count
    tried = bisect_left(sizes, room + 1)
    for first in sizes[max(0, tried - 4 * limit) : tried][::-1]:
        picked, rest = [first], room - first
        count[first] -= 1
        while rest:
            # The largest that fits and has not been picked up already.
            n = bisect_left(sizes, rest + 1) - 1
            while n >= 0 and not count[sizes[n]]:
                n -= 1
            if n < 0:
                break
            size = sizes[n]
            picked.append(size)
            count[size] -= 1
            rest -= size
        for size in picked:
            count[size] += 1
        total = room - rest
        if len(picked) == 1 or total > single:
            found[tuple(picked)] = total
        if not rest and len(found) >= limit:
            break
    return sorted(found, key=lambda f: (-found[f], len(f)))[:limit]


def pack_sizes(sizes: list[int], length: int = LENGTH, nodes: int = NODES) -> list[list[int]]:
    """Places of ``sizes`` (each 1 to ``length``) by sequence, as few as are found."""
    if not sizes:
        return []
    total = sum(sizes)
    fewest = -(-total // length)
    incumbent = [[sizes[i] for i in s] for s in best_fit(sizes, length)]
    if len(incumbent) > fewest:
        left = _Left(sizes, length)
        chosen: list[tuple[int, ...]] = []
        waste, steps = 0, 0
        # Depth first; a frame holds the fillings still to be tried there.
        frames: list[Iterator] = []
        going_down = True
        while steps < nodes and len(incumbent) > fewest:
            allowed = (len(incumbent) - 1) * length - total
            if going_down:
                if not left.sizes:
                    incumbent = [list(s) for s in chosen]
                    going_down = False
                    continue
                steps += 1
                largest = left.sizes[-1]
                left.take(largest)
                options = [(largest, *f) for f in fillings(left, length - largest)]
                left.put(largest)
                frames.append(iter(options))
                going_down = False
            step = next(frames[-1], None)
            if step is not None:
                lost = length - sum(step)
                if waste + lost <= allowed:
                    for size in step:
                        left.take(size)
                    chosen.append(step)
                    waste += lost
                    going_down = True
                    continue
                step = None  # the others of this frame waste no less
            frames.pop()
            if not frames:
                break
            back = chosen.pop()
            waste -= length - sum(back)
            for size in back:
                left.put(size)
    # From sizes to places: equal sizes are alike.
    places: dict[int, list[int]] = {}
    for at, size in enumerate(sizes):
        places.setdefault(size, []).append(at)
    return [[places[size].pop() for size in sequence] for sequence in incumbent]


def pieces(encoded: DataFrame, length: int = LENGTH, key: str = "doc_id") -> DataFrame:
    """Documents as pieces: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    ``encoded`` has ``key`` and ``ids`` (binary, little-endian unsigned 16-bit).
    Rows without ids have no piece.
    """

    def run(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", "<u2")
                for n, start in enumerate(range(0, len(ids), length)):
                    part = ids[start : start + length].astype("<u4")
                    row = (k, n, start, len(part), zlib.crc32(part.tobytes()))
                    for column, value in zip(columns, row):
                        column.append(value)
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                [key, "piece", "start", "length", "ids_crc32"],
            )

    source = encoded.select(key, "ids")
    kind = dict(source.dtypes)[key]
    return source.mapInArrow(
        run, f"{key} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP, key: str = "doc_id") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: gapless from 0 in every sequence.

    ``cut`` is read twice (once to count), so land it first.  Repeated rows are
    pieces of their own, and null keys are keys like others.  Groups grow in
    number with the pieces, never in size.
    """
    schema = cut.schema.simpleString()[7:-1] + ", sequence_id bigint, offset bigint"
    names = [*cut.columns, "sequence_id", "offset"]
    groups = max(1, -(-cut.count() // group))
    # Equal rows would all hash alike; they are told apart by their place.
    order = F.monotonically_increasing_id()
    dealt = cut.withColumn("dealt", F.pmod(F.xxhash64(key, "piece", "ids_crc32", order), F.lit(groups)))

    def solve(ids: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="dealt").reset_index(drop=True)
        sequence = np.zeros(len(rows), np.int64)
        offset = np.zeros(len(rows), np.int64)
        sizes = rows["length"].to_numpy()
        full = np.flatnonzero(sizes == length)
        sequence[full] = np.arange(len(full))
        others = np.flatnonzero(sizes < length)
        for n, places in enumerate(pack_sizes(sizes[others].tolist(), length), len(full)):
            at = 0
            for place in others[places]:
                sequence[place], offset[place] = n, at
                at += int(sizes[place])
        return rows.assign(sequence_id=sequence + (int(ids[0]) << 32), offset=offset)[names]

    return spread(dealt, "dealt").groupBy("dealt").applyInPandas(solve, schema)


def sequences(encoded: DataFrame, packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ids of every sequence: ``sequence_id``, ``ids`` (binary) — for unique keys."""
    width = F.lit(2)
    part = F.substring(
        "ids", (F.col("start") * width + 1).cast("int"), (F.col("length") * width).cast("int")
    )
    return (
        packed.join(encoded.select(key, "ids"), key)
        .select("sequence_id", "offset", part.alias("part"))
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("parts"))
        .select(
            "sequence_id",
            F.aggregate("parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["part"])).alias("ids"),
        )
    )


def pack_documents(encoded: DataFrame, length: int = LENGTH, key: str = "doc_id") -> DataFrame:
    """:func:`pieces` and :func:`pack` in one."""
    return pack(landed(pieces(encoded, length, key), "pieces"), length, key=key)
