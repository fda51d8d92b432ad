import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from hirelake.llm import filteraudit as audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = WORD.findall(text)
    capitals, symbols = len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text))
    return len(words), len(set(words)), capitals, len(text), symbols


def brute(rows, labels):
    """Filters applied one by one, in every order."""
    docs = []
    for key, part, text in rows:
        text = text or ""
        n, distinct, capitals, points, symbols = measures(text)
        copy = key is not None and any(k is not None and k < key and (t or "") == text for k, _, t in rows)
        fails = (n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * points, symbols > 0, copy)
        mine = [x for x in labels if key is not None and x[0] == key]
        docs.append((part or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in permutations(range(5)):
            kept = [d for d in docs if d[0] == part]
            every, name = list(kept), "".join("ABCDE"[i] for i in order)
            for step, i in enumerate(order, 1):
                gone = [d for d in kept if d[1][i]]
                left = [d for d in kept if not d[1][i]]
                redundant = sum(d[1][i] for d in every) - len(gone)
                alone = sum(d[1][i] and sum(d[1]) == 1 for d in every)
                out[part, name, step] = (
                    len(left), len(gone), redundant, alone, sum(d[2] for d in gone), sum(d[3] for d in gone)
                )
                shapley[part, i] = shapley.get((part, i), 0) + len(gone)
                kept = left
    return {k: (*v, shapley[k[0], "ABCDE".index(k[1][k[2] - 1])]) for k, v in out.items()}


def told(df):
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in rows}


def test_against_brute_force_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, "en", long), (2, "en", long), (2, "en", long), (3, None, long), (None, "en", long), (None, "", long),
        (4, "de", None), (5, "de", ""), (6, "en", "A B C " * 50), (7, "en", "a # b"), (8, "en", long + " #"),
        (9, "fr", "ÄÖÜ " * 200), (10, "fr", "漢字 🙂 x\x1cy " * 40), (11, "en", "X" * 5000 + " " + long),
        (12, "en", long.upper()), (13, "en", "word " * 30_000), (0, "fr", long),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (6, 0, 1), (6, 1, None), (8, None, 1), (None, 1, 1), (99, 1, 1), (4, 1, 0)]
    docs = spark.createDataFrame(
        [(*r, 5, 6, "x") for r in rows], "doc_id bigint, lang string, text string, part int, n int, digest string"
    )
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = told(audit.audit(docs, known))
    assert got == brute(rows, labels)
    assert len(got) == 4 * 600
    assert told(audit.audit(docs.limit(0), known)) == {}
    assert len(told(audit.audit(docs, known.limit(0)))) == 4 * 600


@pytest.mark.parametrize("segment", [7, 1 << 20])
def test_transducer_on_any_cut(monkeypatch, segment):
    monkeypatch.setattr(audit, "SEGMENT", segment)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab AÉ\t\n漢#🙂"), rng.integers(0, 60))) for _ in range(300)] + ["", " ", "x"]
    found = audit.counts_of(pa.array([t.encode() for t in texts], pa.binary()))
    assert [tuple(found[m][i] for m in audit.MEASURES) for i in range(len(texts))] == list(map(measures, texts))
    some = pa.array([t.encode() for t in texts], pa.binary())[100:200]
    assert audit.counts_of(some)["n_words"].tolist() == found["n_words"][100:200].tolist()


def test_equal_hashes_are_verified():
    data = np.frombuffer(b"one two one six two", np.uint8)
    starts, ends = np.array([0, 4, 8, 12, 16]), np.array([3, 7, 11, 15, 19])
    same = np.zeros(5, np.uint64)
    assert audit.distinct_words(data, starts, ends, np.zeros(5, np.int64), 1, same).tolist() == [3]
    assert audit.distinct_words(data, starts, ends, np.array([0, 0, 0, 1, 1]), 2, same).tolist() == [2, 2]
