"""Groups of spelling variants: words that differ by one code point.

Two words are near if one inserted, deleted or replaced code point makes them
equal.  Words of one length and the next are compared in blocks: a NumPy product
of the letter counts of a block gives the squared distances of all its pairs;
an edit changes no more than two counts by one, so pairs at most two apart stay,
and their letters are checked.

What makes a block follows from where the edit can be.  The shorter word's
length is cut into pieces of two code points (no more than ``PIECES`` of them);
the edit lies in one piece, and all in front of it and behind it is equal.  So
words meet once a piece, with those that agree outside it, and a pair counts in
the first piece that fits.  A block holds words that differ by no more than the
piece, so its size does not follow the vocabulary; a block that is large all the
same is dealt into parts, which meet two by two in tasks of their own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import landed, spread, whole_text

#: A to Z (lowered) and U+00C0 to U+00FF, as UTF-8.
RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
#: A run of a document loses a letter if this divides its hash.
DROPS = 31
SHORTEST, LEAST = 7, 2
#: A form is this many times as frequent as its variant.
FORM_RATIO = 10
#: Pieces of a word, at most.
PIECES = 32
#: Members of a block that are compared in one product; larger blocks are dealt into parts.
BLOCK = 1024
#: Letter counts are kept in so many columns, by code point modulo it.
LETTERS = 64
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Rows of blocks, and cells of products, that are worked on at once.
ROWS, CELLS = 20_000, 1 << 22


def variant(run: bytes, seed: int) -> bytes:
    """The run as its document spells it; ``seed`` is the crc32 of what stands before it."""
    h = zlib.crc32(run, seed)
    if h % DROPS:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(documents: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``word`` and ``n`` over whole texts.  A null doc_id stands as an empty one."""

    def rows(counter: Counter):
        words = pa.array(list(counter), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counter.values()), pa.int64())], ["word", "n"])

    def run(batches):
        counter = Counter()
        for batch in batches:
            for key, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                seed = zlib.crc32(f"{key}:".encode())
                for found, n in Counter(RUN.findall(text.lower())).items():
                    if len(found) >= shortest:
                        word = variant(found, seed)
                        if len(word) - word.count(b"\xc3") >= shortest:
                            counter[word] += n
                if len(counter) > HELD:
                    yield rows(counter)
                    counter = Counter()
        yield rows(counter)

    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    texts = documents.select(key.alias("key"), whole_text().cast("binary").alias("text"))
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _piece(length: Column) -> Column:
    """Code points of a piece in words of this length."""
    return F.greatest(F.lit(2), F.ceil(length / PIECES).cast("int"))


def block_keys(words: DataFrame, shortest: int) -> DataFrame:
    """``word``, ``n``, ``length`` (of the shorter words of the block), ``at`` and ``to`` (the piece),
    ``rest`` (a hash of what is around it): the blocks that a word takes part in."""
    size = F.char_length("word")
    kinds = words.withColumn("length", F.explode(F.array(size, size - 1))).filter(F.col("length") >= shortest)
    last = F.col("length") - 1
    cut = kinds.withColumn("at", F.explode(F.sequence(F.lit(0), last, _piece(F.col("length")))))
    to = F.least(F.col("length"), F.col("at") + _piece(F.col("length")))
    behind = F.col("length") - to
    rest = F.xxhash64(F.left("word", F.col("at")), F.right("word", behind))
    return cut.select("word", "n", "length", "at", to.alias("to"), rest.alias("rest"))


BLOCK_KEY = ["length", "at", "to", "rest"]


def blocks(words: DataFrame, shortest: int) -> DataFrame:
    """One row per block, or per two parts of a large one: its key and ``members`` (word, n, part)."""
    # A few bytes of words are many keys: dealt over all tasks first.
    keys = block_keys(spread(words, "word"), shortest)
    large = keys.groupBy(*BLOCK_KEY).agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK)
    large = landed(large.select(*BLOCK_KEY, F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "large-blocks")
    parts = F.coalesce("parts", F.lit(1))
    dealt = (
        keys.join(large, BLOCK_KEY, "left")
        .withColumn("part", F.pmod(F.xxhash64("word", F.lit(5)), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumns({"left": F.least("part", "other"), "right": F.greatest("part", "other")})
    )
    members = F.collect_list(F.struct("word", "n", "part")).alias("members")
    grouped = dealt.groupBy(*BLOCK_KEY, "left", "right").agg(members)
    return grouped.filter(F.size("members") > 1)


def letter_counts(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A row of letter counts a word, from the code points of all of them."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    cells = np.bincount(row * LETTERS + points % LETTERS, minlength=len(lengths) * LETTERS)
    return cells.reshape(-1, LETTERS).astype(np.float32)


def close_pairs(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block with squared distances of at most two.

    Blocks of like size are stacked, so one product serves many of them.
    """
    left, right = [], []
    widths = 1 << np.ceil(np.log2(sizes)).astype(int)
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        step = max(1, int(CELLS // (width * max(width, LETTERS))))
        for at in range(0, len(chosen), step):
            some = chosen[at : at + step]
            rows = starts[some, None] + np.arange(width)
            real = np.arange(width) < sizes[some, None]
            rows[~real] = 0
            x = letters[rows]
            products = x @ x.transpose(0, 2, 1)
            squares = np.einsum("gii->gi", products)
            apart = squares[:, :, None] + squares[:, None, :] - 2 * products
            fits = np.triu(np.ones((width, width), bool), 1) & (apart <= 2)
            block, i, j = np.nonzero(fits & real[:, :, None] & real[:, None, :])
            left.append(rows[block, i])
            right.append(rows[block, j])
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(left), np.concatenate(right)


def one_edit(points, firsts, lengths, a, b, at, to) -> np.ndarray:
    """Whether words a and b (a not longer, and no more than one shorter) are one edit apart,
    and ``at`` to ``to`` is the first piece of the shorter that the edit can lie in."""
    out = np.zeros(len(a), bool)
    order = np.argsort(lengths[b], kind="stable")
    while len(order):
        width = int(lengths[b[order[0]]])
        # Words of like length share a table; a longer one waits for a wider table.
        now = order[: max(1, int(np.searchsorted(lengths[b[order]], 2 * width, "right")))]
        now = now[: max(1, CELLS // int(2 * width))]
        order = order[len(now) :]
        x, y = a[now], b[now]
        width = int(lengths[y].max())
        column = np.arange(width)
        inside = column < lengths[x, None]
        table = [np.minimum(firsts[w, None] + column, len(points) - 1) for w in (x, y)]
        differs = (points[table[0]] != points[table[1]]) & inside
        front = np.where(differs.any(1), differs.argmax(1), lengths[x])
        table = [np.maximum(firsts[w, None] + lengths[w, None] - 1 - column, 0) for w in (x, y)]
        backward = (points[table[0]] != points[table[1]]) & inside
        back = np.where(backward.any(1), backward.argmax(1), lengths[x])
        longer = lengths[y] - lengths[x]
        replaced = (longer == 0) & (differs.sum(1) == 1) & (at[now] <= front) & (front < to[now])
        first = (at[now] <= front) & (lengths[x] - to[now] <= back)
        earlier = (at[now] > 0) & (lengths[x] - at[now] <= back)
        inserted = (longer == 1) & (front + back >= lengths[x]) & first & ~earlier
        out[now] = replaced | inserted
    return out


def _near(table: pa.Table) -> pa.RecordBatch | None:
    """Both directions of all near pairs of some blocks: ``word``, ``near``, ``near_n``."""
    lists = table.column("members").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    words, n, part = (flat.field(i) for i in range(3))
    texts = words.to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    firsts, starts = np.cumsum(lengths) - lengths, np.cumsum(sizes) - sizes
    i, j = close_pairs(letter_counts(points, lengths), starts, sizes)
    swap = lengths[i] > lengths[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    block = np.searchsorted(starts, i, "right") - 1
    of = {c: table.column(c).to_numpy()[block] for c in ("length", "at", "to", "left", "right")}
    part = part.to_numpy()
    fits = (lengths[i] == of["length"]) & ((of["left"] == of["right"]) | (part[i] != part[j]))
    i, j, at, to = i[fits], j[fits], of["at"][fits], of["to"][fits]
    fits = one_edit(points, firsts, lengths, i, j, at, to)
    i, j = i[fits], j[fits]
    if not len(i):
        return None
    here, there = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
    return pa.RecordBatch.from_arrays([words.take(here), words.take(there), n.take(there)], ["word", "near", "near_n"])


def near_pairs(words: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``word``, ``near``, ``near_n``: every near pair of distinct ``word``s, in both directions, once."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += len(batch.column("members").flatten())
            if rows >= ROWS:
                found = _near(pa.Table.from_batches(held))
                held, rows = [], 0
                if found is not None:
                    yield found
        if held:
            found = _near(pa.Table.from_batches(held))
            if found is not None:
                yield found

    return blocks(words, shortest).mapInArrow(run, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` from ``word`` and ``form``, by doubling the steps each round.

    A form is at least twice as frequent as its word, so chains end and are short.
    """
    now = landed(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("w"), F.col("root").alias("onward"))
        now = landed(
            now.join(onward, F.col("root") == F.col("w"), "left").select(
                "word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")
            ),
            "roots",
        )
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(counts: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = FORM_RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``, one row a word.

    ``counts`` has distinct ``word``s and ``n``; shorter and rarer ones are left
    out, as is a null word.  ``ratio`` must be over 1.  Ties of the most frequent
    near word go to the first in code-point order.  An empty table gives no rows.
    """
    used = (F.char_length("word") >= shortest) & (F.col("n") >= least)
    words = landed(counts.select("word", "n").filter(used), "words")
    best = near_pairs(words, shortest).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    enough = -F.col("best.less") >= ratio * F.col("n")
    told = landed(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    root = roots(told.filter(F.col("form").isNotNull()))
    return told.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(documents: DataFrame) -> DataFrame:
    """The variants of all words of the documents; see :func:`variants` and :func:`word_counts`."""
    return variants(word_counts(documents))
