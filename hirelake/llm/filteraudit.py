"""What each filter removes in every order of five filters.

A table-driven byte transducer reads each UTF-8 text once: its state says
whether the byte before was white space, and an entry of its table, by state
and byte, says what the byte emits (a word's start, a word's end, a capital, a
code point, a symbol).  The word spans go into a hash table with open
addressing; a span that meets one of equal hash is compared byte by byte, so
equal hashes of different words do no harm.

Filters, as the conditions of failing:

* A: under 100 words
* B: 100 x distinct words < 80 x words
* C: 100 x capitals A-Z > 10 x code points
* D: holds any of ``#$%&*|``
* E: identical to the text of a smaller doc_id, wherever that one went

Texts with the same set of failures behave alike in any order, so all orders
follow from 32 counts a part.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import whole_text

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#$%&*|"
START, END, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16
#: Odd multipliers of the two steps of a span's hash.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are hashed or compared at once.
SEGMENT = 1 << 20


def _emissions() -> np.ndarray:
    """By state (0: behind white space, 1: in a word) x 256 + byte: what is emitted."""
    table = np.zeros((2, 256), np.uint8)
    for byte in range(256):
        space = byte in SPACES
        table[:, byte] |= POINT if byte & 0xC0 != 0x80 else 0
        table[:, byte] |= CAPITAL if ord("A") <= byte <= ord("Z") else 0
        table[:, byte] |= SYMBOL if byte in SYMBOLS else 0
        table[0, byte] |= 0 if space else START
        table[1, byte] |= END if space else 0
    return table.ravel()


EMIT = _emissions()
#: State after a byte, times 256; it does not depend on the state before.
NEXT = np.array([0 if b in SPACES else 256 for b in range(256)], np.uint16)


def transduce(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The emissions of every byte.  A text begins behind white space."""
    states = np.zeros(len(data), np.uint16)
    states[1:] = NEXT[data[:-1]]
    firsts = offsets[:-1]
    states[firsts[firsts < len(data)]] = 0
    return EMIT[states + data]


def _totals(flags: np.ndarray, bit: int, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text emit ``bit``."""
    places = np.flatnonzero(flags & bit)
    return np.diff(np.searchsorted(places, offsets))


def word_spans(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a text's end closes its last word."""
    starts, spaces = np.flatnonzero(flags & START), np.flatnonzero(flags & END)
    bounds = np.sort(np.concatenate([spaces, offsets[1:]]))
    return starts, bounds[np.searchsorted(bounds, starts, "right")]


def _segments(lengths: np.ndarray, most: int) -> list[int]:
    """Bounds of runs of spans of about ``most`` bytes together; a longer span is a run alone."""
    ends = np.cumsum(lengths)
    bounds, at = [0], 0
    while at < len(lengths):
        reached = ends[at - 1] if at else 0
        at = max(at + 1, int(np.searchsorted(ends, reached + most, "right")))
        bounds.append(at)
    return bounds


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span, segment by segment."""
    out = np.empty(len(starts), np.uint64)
    bounds = _segments(ends - starts, SEGMENT)
    for left, right in zip(bounds, bounds[1:]):
        low, lengths = starts[left:right], (ends - starts)[left:right]
        firsts = np.cumsum(lengths) - lengths
        within = np.arange(lengths.sum()) - np.repeat(firsts, lengths)
        powers = np.full(int(lengths.max()), BASE, np.uint64)
        powers[0] = 1
        values = data[np.repeat(low, lengths) + within] + np.uint64(1)
        out[left:right] = np.add.reduceat(values * np.multiply.accumulate(powers)[within], firsts)
    out ^= out >> np.uint64(31)
    out *= MIX
    return out ^ (out >> np.uint64(29))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans that start at ``a`` and ``b`` and have one length are equal."""
    out = np.empty(len(a), bool)
    bounds = _segments(lengths, SEGMENT)
    for left, right in zip(bounds, bounds[1:]):
        n = lengths[left:right]
        firsts = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(firsts, n)
        equal = data[np.repeat(a[left:right], n) + within] == data[np.repeat(b[left:right], n) + within]
        out[left:right] = np.logical_and.reduceat(equal, firsts)
    return out


def distinct_words(data, starts, ends, text: np.ndarray, texts: int, hashes=None) -> np.ndarray:
    """How many different words each text has.

    ``text`` is the number of the text of each span.  All spans that are not
    placed yet try their slot at once: one of those that meet at an empty slot
    takes it and is new; the others are the same word as its holder, or go on to
    the next slot.
    """
    hashes = span_hashes(data, starts, ends) if hashes is None else hashes
    lengths = ends - starts
    bits = max(4, int(2 * len(starts) + 1).bit_length())
    mask = (1 << bits) - 1
    slots = np.full(mask + 1, -1, np.int64)
    place = ((hashes + text.astype(np.uint64) * BASE) >> np.uint64(64 - bits)).astype(np.int64)
    new = np.zeros(len(starts), bool)
    waiting = np.arange(len(starts))
    while len(waiting):
        at = place[waiting]
        free = slots[at] < 0
        slots[at[free]] = waiting[free]
        holder = slots[at]
        new[waiting[holder == waiting]] = True
        alike = (hashes[holder] == hashes[waiting]) & (lengths[holder] == lengths[waiting])
        alike &= text[holder] == text[waiting]
        check = np.flatnonzero(alike & (holder != waiting))
        if len(check):
            mine, other = waiting[check], holder[check]
            alike[check] = same_bytes(data, starts[mine], starts[other], lengths[mine])
        waiting = waiting[~alike]
        place[waiting] = (place[waiting] + 1) & mask
    return np.bincount(text[new], minlength=texts)


def counts_of(texts: pa.BinaryArray) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    flags = transduce(data, offsets)
    starts, ends = word_spans(flags, offsets)
    text = np.searchsorted(offsets, starts, "right") - 1
    return {
        "n_words": np.bincount(text, minlength=len(texts)),
        "n_distinct": distinct_words(data, starts, ends, text, len(texts)),
        "n_capitals": _totals(flags, CAPITAL, offsets),
        "n_points": _totals(flags, POINT, offsets),
        "n_symbols": _totals(flags, SYMBOL, offsets),
    }


MEASURES = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]


def measured(documents: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and the ``MEASURES`` of each text; null texts count as empty."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = counts_of(batch.column(0))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], *(pa.array(found[m].astype(np.int64)) for m in MEASURES)],
                    [*batch.schema.names[1:], *MEASURES],
                )

    source = documents.select(whole_text().cast("binary").alias("_text"), *keep)
    kept = [f"`{n}` {t}" for n, t in source.dtypes[1:]]
    return source.mapInArrow(run, ", ".join(kept + [f"{m} bigint" for m in MEASURES]))


def own_failures() -> Column:
    """The set of A to D that a text fails, as bits."""
    fails = [
        F.col("n_words") < 100,
        100 * F.col("n_distinct") < 80 * F.col("n_words"),
        100 * F.col("n_capitals") > 10 * F.col("n_points"),
        F.col("n_symbols") > 0,
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failure_sets(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``fails`` (bits of A to E), ``good``, ``toxic``, ``n``.

    Copies shrink before they meet: one row per text, part and labels and task.
    E asks for a smaller doc_id, so all rows of the smallest one pass it, and a
    row without doc_id is not compared.  Of several label rows of a document any
    that says 1 counts; documents without labels are neither good nor toxic.
    """
    known = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    key, digest = F.col("doc_id").alias("doc_id"), F.sha2(whole_text(), 256)
    told = measured(
        documents, key, F.coalesce("lang", F.lit("")).alias("part"), F.unhex(digest).alias("digest")
    ).select("doc_id", "part", "digest", own_failures().alias("fails"))
    rows = told.groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n"))
    no = F.lit(False)
    rows = rows.join(known, "doc_id", "left").withColumns(
        {"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)}
    )
    kinds = ["digest", "part", "fails", "good", "toxic"]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = rows.groupBy(*kinds).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("keyless"),
        first.alias("first"),
    )
    lowest = groups.groupBy(F.col("digest").alias("d")).agg(F.min("first.doc_id").alias("lowest"))
    firsts = F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(0)
    alone = F.col("keyless") + F.coalesce(firsts, F.lit(0))
    told = groups.join(lowest, F.col("digest") == F.col("d")).withColumn("alone", alone)
    copy = 1 << FILTERS.index("E")
    both = F.array(
        F.struct(F.col("fails").alias("fails"), F.col("alone").alias("n")),
        F.struct((F.col("fails") + copy).alias("fails"), (F.col("n") - F.col("alone")).alias("n")),
    )
    return (
        told.select("part", "good", "toxic", F.explode(both).alias("x"))
        .groupBy("part", F.col("x.fails").alias("fails"), "good", "toxic")
        .agg(F.sum("x.n").alias("n"))
    )


def orders() -> Column:
    """Every step of every order: a struct of its name, number, filter and the filters before it."""
    steps = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            steps.append(f"('{order}', {step}, {bit}, {before})")
            before |= bit
    told = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    return F.expr(f"cast(array({', '.join(steps)}) AS {told})")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see the module.

    An empty table has no parts and gives no rows; a null ``lang`` is part ''.
    """
    sets = failure_sets(documents, labels)
    sums = []
    for name, test in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))):
        cells = [F.sum(F.when(test & (F.col("fails") == s), F.col("n")).otherwise(0)) for s in range(SETS)]
        sums.append(F.array(*cells).alias(f"all_{name}"))
    by_part = sets.groupBy("part").agg(*sums).select("*", F.explode(orders()).alias("o"))
    bit, before = F.col("o.bit"), F.col("o.before")

    def total(name: str, test) -> Column:
        """The sum over all sets that ``test`` (set -> condition) holds for."""
        cells = F.transform(f"all_{name}", lambda n, s: F.when(test(s.cast("int")), n).otherwise(0))
        return F.aggregate(cells, F.lit(0).cast("bigint"), lambda a, n: a + n)

    def fails(s):
        return s.bitwiseAND(bit) > 0

    def earlier(s):
        return s.bitwiseAND(before) > 0

    share = F.transform("all_n", lambda n, s: F.when(fails(s.cast("int")), n * F.lit(120) / F.bit_count(s)).otherwise(0.0))
    shares = F.aggregate(share, F.lit(0.0), lambda a, n: a + n)
    return by_part.select(
        "part",
        "o.filter_order",
        "o.step",
        total("n", lambda s: ~fails(s) & ~earlier(s)).alias("kept"),
        total("n", lambda s: fails(s) & ~earlier(s)).alias("removed"),
        total("n", lambda s: fails(s) & earlier(s)).alias("redundant"),
        total("n", lambda s: s == bit).alias("unique_fails"),
        total("good", lambda s: fails(s) & ~earlier(s)).alias("good_lost"),
        total("toxic", lambda s: fails(s) & ~earlier(s)).alias("toxic_lost"),
        F.round(shares).cast("bigint").alias("shapley"),
    )
