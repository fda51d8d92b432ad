"""Similarity join of texts by the Jaccard index of their word n-grams.

1. Texts with the same set of n-grams form a class; the smallest key stands for it.
2. MinHash signatures are cut into bands.  Classes that agree in a band are
   candidates; each is tied to the smallest of its bucket, and tied classes form
   a cell.  Bands and rows are chosen for a target recall at the threshold.
3. Within a cell all classes are compared on their full n-gram sets, two blocks
   at a time, so no pair is ever a row and no large group is one task.  A block
   pair reports the number of links of each class, weighted by the classes'
   sizes, and a spanning forest of the links.
4. Components of that forest are the groups.

N-grams are 64-bit hashes of five words: lower-case runs of letters, digits and
underscores.  A text of fewer words is one n-gram, and a text without words but
not empty is one n-gram by itself.  Null and empty texts link with nothing.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import by_group, landed, whole_text
from hirelake.llm.components import BLOCK, block_pairs, components, smallest_reachable

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Hash functions at most.
HASHES = 128
WORD = re.compile(r"\w+")
REMEMBERED = 400_000
#: Columns of the incidence matrix handled at once.
COLUMNS = 4096


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES):
    """The most rows a band, and fewest bands, that find a pair at the threshold with ``recall``."""
    for rows in range(hashes, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError(f"{hashes} hash functions cannot reach a recall of {recall}")


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def ngrams(text: str, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """The set of n-grams of a text, as ascending unsigned 64-bit hashes."""
    found = WORD.findall(text.lower())
    if not found:
        found = [text] if text else []
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1) if len(h) else 0
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for i in range(min(words, len(h))):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


class MinHash:
    """Band hashes of n-gram sets, many texts at a time."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(11)
        self.bands, self.rows = bands, rows
        self.flip = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.times = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)

    def band_hashes(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per set; none of them is empty."""
        starts = np.cumsum([0, *map(len, sets[:-1])])
        low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        work = np.empty_like(low)
        out = np.zeros((len(sets), self.bands), np.uint64)
        for k, (flip, times) in enumerate(zip(self.flip, self.times)):
            np.bitwise_xor(low, flip, out=work)
            np.multiply(work, times, out=work)
            least = np.minimum.reduceat(work, starts).astype(np.uint64)
            band = out[:, k // self.rows]
            band ^= least
            band *= np.uint64(0xD6E8FEB86659FD93)
            band ^= band >> np.uint64(32)
        return out.view(np.int64)


def signatures(documents: DataFrame, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """``key``, ``digest`` (of the n-gram set; null if there is none), ``bands``."""

    def run(batches):
        hashes, minhash = WordHashes(), MinHash(bands, rows)
        for batch in batches:
            sets = [ngrams(x, hashes) for x in batch.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            digest: list = [None] * len(sets)
            told: list = [None] * len(sets)
            if full:
                for i, row in zip(full, minhash.band_hashes([sets[i] for i in full])):
                    digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    told[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.binary()), pa.array(told, pa.list_(pa.int64()))],
                ["key", "digest", "bands"],
            )

    source = documents.select(F.col(key).cast("bigint").alias("key"), whole_text(text).alias("text"))
    return source.mapInArrow(run, "key bigint, digest binary, bands array<bigint>")


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left sets with the right ones."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # an n-gram of one set adds to no intersection
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(left), len(right)), np.float64)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + COLUMNS, COLUMNS))
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            width = int(column[b - 1] - column[a]) + 1
            dense = np.zeros((len(sets), width), np.float32)
            dense[owner[a:b], column[a:b] - column[a]] = 1
            total += dense[left] @ dense[right].T
    return total


def _compare(threshold: float):
    hashes = WordHashes()

    def run(group: pa.Table) -> pa.RecordBatch | None:
        rows = group.to_pylist()
        if len(rows) < 2:
            return None
        rows.sort(key=lambda r: r["node"])
        sets = [ngrams(r["text"], hashes) for r in rows]
        first, second = rows[0]["left"], rows[0]["right"]
        block = np.array([r["block"] for r in rows])
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        if not len(left) or not len(right):
            return None
        size = np.array([len(s) for s in sets], np.float64)
        both = _intersections(sets, left, right)
        union = size[left][:, None] + size[right][None, :] - both
        linked = np.zeros((len(rows), len(rows)), bool)
        linked[np.ix_(left, right)] = both >= threshold * union - 1e-9
        linked |= linked.T
        np.fill_diagonal(linked, False)
        copies = np.array([r["copies"] for r in rows], np.int64)
        links = linked @ copies
        tie = smallest_reachable(linked)
        node = np.array([r["node"] for r in rows], np.int64)
        told = links > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(node[told]), pa.array(node[tie][told]), pa.array(links[told])],
            ["node", "tie", "links"],
        )

    return run


def near_copies(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """Every distinct key with its class, its group and its number of links.

    ``key``, ``class_id`` (the smallest key with the same n-gram set),
    ``n_links`` (other keys at or over the threshold), ``group_id`` (the
    smallest key reachable by links).  A text without n-grams is a group by
    itself.  Keys are unique or repeat whole rows, which count once; should a
    key have several texts, each is compared and it keeps the smallest class
    and group and the most links.  Rows with a null key are left out.
    """
    bands, rows = bands_and_rows(threshold, recall)
    keyed = documents.filter(F.col(key).isNotNull())
    signed = landed(signatures(keyed, bands, rows, key, text), "signatures")
    told = signed.filter(F.col("digest").isNotNull())
    classes = landed(
        told.dropDuplicates(["key", "digest"])
        .groupBy("digest")
        .agg(
            F.min("key").alias("node"),
            F.count("*").alias("copies"),
            F.any_value("bands").alias("bands"),
        ),
        "classes",
    )
    banded = classes.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = (
        banded.groupBy("band", "hash")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .filter(F.col("low") < F.col("high"))
    )
    ties = banded.join(buckets, ["band", "hash"]).select(F.col("node").alias("x"), F.col("low").alias("y"))
    cells = landed(
        components(ties)
        .withColumnRenamed("component", "cell")
        .join(classes.select("node", "copies"), "node"),
        "cells",
    )
    texts = keyed.select(F.col(key).cast("bigint").alias("node"), whole_text(text).alias("text"))
    # Merged at every size: the members grow with the data, so no plan that small inputs
    # alone can have (a broadcast of the members) stands for that of large ones.
    work = (
        block_pairs(cells, "cell", "node", BLOCK)
        .join(texts.hint("merge"), "node")
        .select("cell", "left", "right", "block", "node", "copies", "text")
    )
    found = landed(
        by_group(
            work, ["cell", "left", "right"], _compare(threshold), "node bigint, tie bigint, links bigint"
        ),
        "links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("x"), F.col("tie").alias("y")))
    by_class = (
        classes.select("digest", "node", "copies")
        .join(links, "node", "left")
        .join(groups, "node", "left")
        .select(
            "digest",
            F.col("node").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("group_id"),
        )
    )
    return (
        signed.select("key", "digest")
        .join(by_class, "digest", "left")
        .groupBy("key")
        .agg(
            F.coalesce(F.min("class_id"), F.first("key")).alias("class_id"),
            F.coalesce(F.max("n_links"), F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce(F.min("group_id"), F.first("key")).alias("group_id"),
        )
        .withColumnRenamed("key", key)
    )
