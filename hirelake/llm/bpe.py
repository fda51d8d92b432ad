"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merges of one pre-token are taken from a queue ordered by rank.  A bucket per
rank holds the positions whose pair has that rank; a two-level bitmap tells
which buckets hold anything, and find-first-set on both levels names the next
one.  Tokens are a linked list over byte positions, so a merge touches only its
two neighbours.  A position whose pair has changed since it was queued is
skipped when it comes up.  A pre-token of n bytes costs O(n log n), however
long it is.

Pre-tokens repeat, so each worker keeps their ids; that memory is bounded and
only saves time.
"""

from __future__ import annotations

import base64
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import whole_text

#: Ranks that one word of the lower bitmap level covers, as a power of two.
LEAF_BITS = 8
LEAF_MASK = (1 << LEAF_BITS) - 1
#: Entries a worker remembers, at most (about 250 bytes each).
REMEMBERED = 1_200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: lowest rank first, leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    n, rank_of = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    buckets: dict[int, list[int]] = {}
    leaves: dict[int, int] = {}
    root = 0
    # The rank of the pair that starts at a position; None: none, or no token starts there.
    now = [rank_of(piece[i : i + 2]) for i in range(n)]
    now[-1] = None
    for i, rank in enumerate(now):
        if rank in buckets:
            buckets[rank].append(i)
        elif rank is not None:
            buckets[rank] = [i]
            high = rank >> LEAF_BITS
            if high in leaves:
                leaves[high] |= 1 << (rank & LEAF_MASK)
            else:
                leaves[high] = 1 << (rank & LEAF_MASK)
                root |= 1 << high
    while root:
        root_bit = root & -root
        high = root_bit.bit_length() - 1
        leaf = leaves[high]
        leaf_bit = leaf & -leaf
        lowest = (high << LEAF_BITS) + leaf_bit.bit_length() - 1
        bucket = buckets[lowest]
        i = heappop(bucket)
        if not bucket:
            del buckets[lowest]
            if leaf == leaf_bit:
                del leaves[high]
                root ^= root_bit
            else:
                leaves[high] = leaf ^ leaf_bit
        if now[i] != lowest:  # stale
            continue
        gone = after[i]
        end = after[i] = after[gone]
        now[gone] = now[i] = None
        if end < n:
            before[end] = i
            touched = ((i, piece[i : after[end]]), (before[i], piece[before[i] : end]))
        else:
            touched = ((before[i], piece[before[i] : end]),)
        for at, pair in touched:
            if at < 0:
                continue
            rank = now[at] = rank_of(pair)
            if rank in buckets:
                heappush(buckets[rank], at)
            elif rank is not None:
                buckets[rank] = [at]
                high = rank >> LEAF_BITS
                if high in leaves:
                    leaves[high] |= 1 << (rank & LEAF_MASK)
                else:
                    leaves[high] = 1 << (rank & LEAF_MASK)
                    root |= 1 << high
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class _Memory(dict):
    """Values by key, worked out when first asked for and kept up to a bound."""

    def __init__(self, work_out):
        super().__init__()
        self.work_out = work_out

    def __missing__(self, key):
        value = self.work_out(key)
        if len(self) < REMEMBERED:
            self[key] = value
        return value


class _NoCut(Exception):
    """White space or nothing behind a space: no place to cut."""


class Codec:
    """Encodes and decodes texts by a table of ranks and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pre_tokens = _Memory(lambda token: merge(token.encode(), ranks))
        self.after_space = _Memory(self._after_space)

    def _matches(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pre_tokens.__getitem__, self.pattern.findall(text))))

    def _after_space(self, rest: str) -> list[int]:
        # Python's white space is a superset of the pattern's.
        if not rest or rest[0].isspace():
            raise _NoCut
        first, *others = self.pattern.findall(" " + rest)
        if not others:
            return merge(first.encode(), self.ranks)
        # The first match is remembered without its space, as a part of its own.
        ids = [*self.after_space[first[1:]]] if len(first) > 1 else [*self.pre_tokens[first]]
        for token in others:
            ids += self.pre_tokens[token]
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text.

        A match of the pattern holds a space only as its first character, so a
        text may be cut before every space that a visible character follows:
        the matches of the parts are the matches of the whole.  Other texts
        are matched as one.
        """
        first, *rest = text.split(" ")
        try:
            return self._matches(first) + list(
                chain.from_iterable(map(self.after_space.__getitem__, rest))
            )
        except _NoCut:
            return self._matches(text)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def _lists(rows: list[list[int]], kind) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def encode_texts(
    documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row.

    Null and empty texts have no ids.  Rows are handled one by one, so repeated
    rows and null keys come out as they came in; other columns are left behind.
    ``path`` is readable on every executor, as installed packages are.
    """

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids, pa.int32())], [key, "ids"])

    source = documents.select(F.col(key).alias(key), whole_text(text).alias("text"))
    return source.mapInArrow(run, f"{key} {dict(source.dtypes)[key]}, ids array<int>")


def encode_and_decode(
    documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """:func:`encode_texts`, and ``decoded``: the bytes that those ids stand for.

    One pass, so that a worker keeps one memory of pre-tokens.
    """

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(x) for x in batch.column(1).to_pylist()]
            decoded = pa.array(map(own.decode, ids), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(ids, pa.int32()), decoded], [key, "ids", "decoded"]
            )

    source = documents.select(F.col(key).alias(key), whole_text(text).alias("text"))
    kind = dict(source.dtypes)[key]
    return source.mapInArrow(run, f"{key} {kind}, ids array<int>, decoded binary")


def decode_ids(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` and ``decoded`` (the bytes they stand for; null ids: no bytes).

    Bytes, as a sequence of ids need not be a valid text.
    """

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            rows = [own.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.binary())],
                [key, "ids", "decoded"],
            )

    source = encoded.select(key, "ids")
    kind = dict(source.dtypes)[key]
    return source.mapInArrow(run, f"{key} {kind}, ids array<int>, decoded binary")
