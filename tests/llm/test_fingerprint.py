import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import entries, fingerprint

SF_DIR = "/root/testdata/sf0.001"
LANES, PHRASES = fingerprint.LANES, fingerprint.HALVES * fingerprint.HALF


def brute(text):
    """Number of phrases, sums of paragraph numbers, and counts of phrase bits."""
    lanes = np.zeros(LANES, object)
    for line in text.split("\n"):
        digest = hashlib.sha256(line.encode()).hexdigest()
        lanes += [int(digest[8 * i : 8 * i + 8], 16) for i in range(LANES)]
    phrases = [p for p in re.split(r"[\n\r]+|[ \t]+(?=[adeoADEO])", text) if p]
    counts = np.zeros(PHRASES, np.int64)
    for phrase in phrases:
        digest = hashlib.md5(phrase.encode()).hexdigest()
        # Each half has 60 bits in three fields of 20; a lane counts one place in all three.
        for h in range(fingerprint.HALVES):
            half = int(digest[15 * h : 15 * h + 15], 16)
            for s in range(fingerprint.FIELD):
                for f in range(3):
                    counts[(h * fingerprint.FIELD + s) * 3 + f] += half >> (s + fingerprint.FIELD * f) & 1
    return len(phrases), [int(x) % (1 << 32) for x in lanes], counts % (1 << fingerprint.FIELD)


def text_form(print_):
    n, lanes, counts = print_
    fields = counts.reshape(-1, 3)
    halves = [sum(int(c) << (fingerprint.FIELD * f) for f, c in enumerate(row)) for row in fields]
    return f"{n:08x}" + "".join(f"{x:08x}" for x in lanes) + "".join(f"{x:015x}" for x in halves)


def likeness(a, b):
    if text_form(a) == text_form(b):
        return 1.0
    x, y = (2.0 * p[2] - p[0] for p in (a, b))
    size = np.sqrt((x @ x) * (y @ y))
    return float(np.clip(x @ y / size, 0, 1)) if size else 0.0


def expected(rows):
    """From rows in their order; each row's next one is the row behind it."""
    out = []
    for n, (key, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        a, e, b = brute(text), brute(edited), brute(after)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_form(a), text_form(e), likeness(a, e), likeness(a, b)))
    return out


def same(got, wanted):
    got = sorted((tuple(r)[:7] for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    wanted = sorted(wanted, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in wanted], atol=1e-9)


def test_every_column_of_all_documents(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    rows = sorted((tuple(r) for r in documents.collect()), key=lambda r: r[0])
    got = entries.queries()["op3_fingerprint"](spark, SF_DIR)
    same(got.collect(), expected(rows))
    near = got.agg(F.avg("near_edited").alias("edited"), F.avg("near_next").alias("after")).first()
    assert near.edited > 0.6 > 0.3 > near.after


def test_odd_rows(spark):
    rows = [
        (-5, "漢字。\n🙂 and\t 'x'"), (0, None), (1, ""), (2, "\n\n"), (3, "one line a d e o"),
        (4, "b\na"), (7, "a\nb"), (9, "word " * 20_000),
    ]
    frame = spark.createDataFrame(
        [(k, t, 1, "x", 2.0) for k, t in rows], "doc_id bigint, text string, n int, lanes string, copy double"
    )
    got = fingerprint.compared(frame).collect()
    same(got, expected(rows))
    by_key = {r.doc_id: r.fingerprint for r in got}
    assert by_key[0] == by_key[1] and by_key[4] == by_key[7] != by_key[3]
    assert fingerprint.compared(frame.limit(0)).count() == 0
    alone = fingerprint.compared(frame.filter("doc_id = 3")).first()
    assert alone.near_next == 1.0


def test_repeated_and_null_keys(spark):
    rows = [(None, "x"), (None, "y"), (1, "one\ntwo"), (1, "one\ntwo"), (1, "three"), (2, "last")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fingerprint.compared(frame).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.n_chars, r.fingerprint) for r in got) == sorted(
        (k or 0, len(t), text_form(brute(t))) for k, t in rows
    )
    # A repeated row comes next to itself.
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == 1) == 1


@pytest.mark.parametrize("sign", [1, -1])
def test_paragraphs_are_put_in_and_taken_out(spark, sign):
    a, b = "first and on\nsecond\n", "third\nof all\nsecond"
    both = a + "\n" + b
    df = spark.createDataFrame([(a, b, both)], "a string, b string, c string")
    for name in "abc":
        df = fingerprint.with_fingerprint(df, name, f"{name}_print")
    if sign == 1:
        made, whole = fingerprint.combined(F.col("a_print"), F.col("b_print")), F.col("c_print")
    else:
        made, whole = fingerprint.combined(F.col("c_print"), F.col("b_print"), -1), F.col("a_print")
    row = df.select(fingerprint.written(made).alias("x"), fingerprint.written(whole).alias("y")).first()
    assert row.x == row.y
    # Order does not matter.
    mixed = spark.createDataFrame([("\n".join(reversed(both.split("\n"))),)], "c string")
    other = fingerprint.with_fingerprint(mixed, "c", "p").select(fingerprint.written(F.col("p"))).first()[0]
    assert other == text_form(brute(both))
