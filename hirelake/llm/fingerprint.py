"""Document fingerprints: homomorphic multiset hashes, in DataFrame functions.

A paragraph is a line, an empty one too.  Its hash is ``LANES`` numbers of 32
bits, cut from SHA-256, and a document's hash is their sum modulo 2**32, lane by
lane: the order of paragraphs does not matter, and one paragraph is put in or
taken out by adding or subtracting its numbers.

Behind these lanes come the ``PHRASE`` lanes, which say how alike two documents
are.  A phrase ends at a line end and before each word that begins with one of a
few letters, so phrases go on alike after an edit.  Its 128-bit MD5 is read as
signs; lane i counts, modulo 2**20, the phrases whose bit i is set.  With n
phrases the sum of signs is twice the count less n, and products of such sums
estimate how many phrases two documents share.

The text form is the number of phrases, the paragraph lanes and the phrase
lanes, each in hexadecimal of fixed width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 8
#: Bits of a hash half, cut into fields of FIELD bits that are counted side by side.
HALF, FIELD, HALVES = 60, 20, 2
FIELD_MASK = sum(1 << at for at in range(0, HALF, FIELD))
HALF_MASK = (1 << HALF) - 1
#: White space before one of these letters ends a phrase, as every line end does.
PHRASE_END = r"[\n\r]+|[ \t]+(?=[adeoADEO])"
#: Ranges of keys for each task of a shuffle.
CHUNKS_A_TASK = 8


def _number(digits: Column, at: int, length: int) -> Column:
    return F.conv(F.substring(digits, at, length), 16, 10).cast("bigint")


def _half(h: int):
    return lambda x: _number(x, 15 * h + 1, 15)


def _sum(values: Column, of, modulus_mask: int) -> Column:
    mask = F.lit(modulus_mask)
    return F.aggregate(
        values, F.lit(0).cast("bigint"), lambda a, x: (a + of(x)).bitwiseAND(mask)
    )


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the struct ``name`` (n, lanes, phrases) of a text column.

    In steps, so that the hashes of phrases are worked out once and then summed
    up by every lane.  A null text is like an empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    names = df.columns
    lanes = F.array(
        *(
            _sum(F.col("_lines"), lambda x, at=at: _number(x, 8 * at + 1, 8), (1 << 32) - 1)
            for at in range(LANES)
        )
    )
    counted = F.array(
        *(
            _sum(
                F.col(f"_half{h}"),
                lambda x, s=s: F.shiftrightunsigned(x, s).bitwiseAND(F.lit(FIELD_MASK)),
                HALF_MASK,
            )
            for h in range(HALVES)
            for s in range(FIELD)
        )
    )
    hashes = F.transform(
        F.filter(F.split(whole, PHRASE_END), lambda x: x != ""), lambda x: F.md5(x)
    )
    return (
        df.select(
            "*",
            F.transform(F.split(whole, "\n"), lambda x: F.sha2(x, 256)).alias("_lines"),
            hashes.alias("_hashes"),
        )
        .select(
            *names,
            "_lines",
            *(
                F.transform("_hashes", _half(h)).alias(f"_half{h}") for h in range(HALVES)
            ),
        )
        .select(
            *names,
            F.struct(
                F.size("_half0").cast("bigint").alias("n"),
                lanes.alias("lanes"),
                counted.alias("phrases"),
            ).alias(name),
        )
    )


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of all paragraphs of two documents, or of a's without b's (sign -1).

    Phrases do not cross lines, so theirs add up too.
    """

    def lanes(x, y):
        return (x + sign * y).bitwiseAND(F.lit((1 << 32) - 1))

    def fields(x, y):
        # Field by field, so that nothing is carried from one to the next.
        parts = [
            F.shiftleft(
                (
                    F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << FIELD) - 1))
                    + sign * F.shiftrightunsigned(y, at).bitwiseAND(F.lit((1 << FIELD) - 1))
                ).bitwiseAND(F.lit((1 << FIELD) - 1)),
                at,
            )
            for at in range(0, HALF, FIELD)
        ]
        return parts[0] + parts[1] + parts[2]

    return F.struct(
        (a["n"] + sign * b["n"]).alias("n"),
        F.zip_with(a["lanes"], b["lanes"], lanes).alias("lanes"),
        F.zip_with(a["phrases"], b["phrases"], fields).alias("phrases"),
    )


def written(print_: Column) -> Column:
    def digits(values: Column, width: int) -> Column:
        return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), width, "0")), "")

    return F.concat(
        F.lpad(F.lower(F.hex(print_["n"])), 8, "0"),
        digits(print_["lanes"], 8),
        digits(print_["phrases"], HALF // 4),
    )


def signs(print_: Column) -> Column:
    """The sum of signs in every phrase lane, as doubles."""
    fields = F.flatten(
        F.transform(
            print_["phrases"],
            lambda x: F.array(
                *(
                    F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << FIELD) - 1))
                    for at in range(0, HALF, FIELD)
                )
            ),
        )
    )
    return F.transform(fields, lambda c: (2 * c - print_["n"]).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column, a_signs: Column, b_signs: Column) -> Column:
    """1 for equal fingerprints, else the estimated cosine of the phrase counts, 0 to 1."""
    size = F.sqrt(_dot(a_signs, a_signs) * _dot(b_signs, b_signs))
    cosine = F.when(size > 0, _dot(a_signs, b_signs) / size).otherwise(F.lit(0.0))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def chunk_bounds(keys: DataFrame, key: str, parts: int) -> list[int]:
    """Keys that cut the rows into about ``parts`` even ranges, ascending.

    Approximate percentiles: a sketch whose size goes with ``parts``.
    """
    cuts = [i / parts for i in range(1, parts)]
    if not cuts:
        return []
    found = keys.agg(F.percentile_approx(key, cuts, max(10_000, 4 * parts)).alias("cuts")).first().cuts
    return sorted(set(found or []))


def _chunk(bounds: list[int]) -> Column:
    """How many bounds lie at or below the key; 0 for a null key."""
    if not bounds:
        return F.lit(0)
    at_or_below = F.filter(F.lit(bounds), lambda b: b <= F.col("key"))
    return F.when(F.col("key").isNull(), 0).otherwise(F.size(at_or_below))


def with_next(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``text``, ``print`` and the ``next_text`` and ``next_print`` of each row.

    Rows are dealt by ranges of the key, the texts once.  The first row of each
    range is copied to the range before it, and that of the first to the last.
    """
    rows = documents.select(
        F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = chunk_bounds(rows.select("key"), "key", CHUNKS_A_TASK * tasks)
    chunked = rows.withColumn("chunk", _chunk(bounds))
    # A row per range: its first key, and the range before it.
    starts = sorted(((r["chunk"], r["key"]) for r in _starts(chunked)), key=lambda s: s[0])
    copies = chunked.filter(_is_one_of([k for _, k in starts])).groupBy("chunk").agg(
        F.min(F.struct("key", F.xxhash64("text").alias("h"), "text")).alias("row")
    )
    before = {c: starts[n - 1][0] for n, (c, _) in enumerate(starts)}
    target = F.lit(None).cast("int") if not before else F.element_at(
        F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("chunk")
    )
    copies = copies.select("row.key", "row.text", target.alias("chunk"), F.lit(1).alias("copy"))
    dealt = chunked.withColumn("copy", F.lit(0)).unionByName(copies).repartition(tasks, "chunk")
    printed = with_fingerprint(dealt, "text", "print")
    order = Window.partitionBy("chunk").orderBy("copy", "key", F.xxhash64("text"), "text")
    return (
        printed.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_print", F.lead("print").over(order))
        .filter(F.col("copy") == 0)
        .drop("copy", "chunk")
    )


def _starts(chunked: DataFrame) -> list:
    """The smallest key of each range: as many rows as there are ranges."""
    return (
        chunked.select("chunk", "key")
        .groupBy("chunk")
        .agg(F.min(F.struct("key")).alias("first"))
        .select("chunk", F.col("first.key").alias("key"))
        .collect()
    )


def _is_one_of(keys: list) -> Column:
    known = [k for k in keys if k is not None]
    test = F.col("key").isin(known) if known else F.lit(False)
    return test | F.col("key").isNull() if None in keys else test


def compared(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of texts, of their edited texts, and how alike they are.

    The edited text has its last quarter of code points (rounded down) replaced
    by the first as many, or all, of the next document in ascending order of
    ``key``; after the last comes the first.  Null texts are empty, and an
    empty text's edited text is empty.  Rows of one key follow one another in
    the order of their texts' hashes, so a repeated row comes next to itself;
    null keys come first.  A single row is its own next document.

    Columns: ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.
    """
    chars = F.char_length("text")
    quarter = F.floor(chars / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (chars - quarter).cast("int")),
        F.substring("next_text", F.lit(1), quarter),
    )
    rows = with_next(documents, key, text).select(
        "key", "print", "next_print", chars.cast("bigint").alias("n_chars"), edited.alias("edited")
    )
    signed = with_fingerprint(rows, "edited", "edited_print").select(
        "*",
        signs(F.col("print")).alias("signs"),
        signs(F.col("next_print")).alias("next_signs"),
        signs(F.col("edited_print")).alias("edited_signs"),
    )

    def like(other: str) -> Column:
        return likeness(F.col("print"), F.col(f"{other}_print"), F.col("signs"), F.col(f"{other}_signs"))

    return signed.select(
        F.col("key").alias(key),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("print")).alias("fingerprint"),
        written(F.col("edited_print")).alias("edited_fingerprint"),
        like("edited").alias("near_edited"),
        like("next").alias("near_next"),
    )
