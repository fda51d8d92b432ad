import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hirelake.llm import entries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_counts(rows):
    found = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def brute_near(words):
    """Pairs with a common string after one deletion, then tested letter by letter."""
    holes = defaultdict(set)
    for w in words:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for some in holes.values():
        for a in some:
            for b in some:
                if a != b and (
                    (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or abs(len(a) - len(b)) == 1
                ):
                    near[a].add(b)
    return near


def brute(words, ratio=10):
    near, out = brute_near(words), {}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def told(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_brute_force(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute(brute_counts(rows))
    assert told(entries.queries()["op11_spelling"](spark, folder)) == expected
    assert sum(x[3] for x in expected.values()) > 20


def test_random_words_of_few_letters(spark, monkeypatch):
    # Few letters and small blocks: many pairs, doubled letters, blocks in parts.
    monkeypatch.setattr(spelling, "BLOCK", 16)
    rng = np.random.default_rng(5)
    words = {
        "".join(rng.choice(list("abé"), rng.integers(7, 11))): int(rng.integers(2, 2000)) for _ in range(3000)
    }
    words |= {("ab" * 60)[: 100 + k]: 2 * 30**k for k in range(3)} | {"x" * 99 + "y": 5, "x" * 100: 70}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    expected = brute(words)
    assert told(spelling.variants(df)) == expected
    assert max(x[3] for x in expected.values()) > 5


def test_chains_ties_and_left_out_words(spark):
    words = [
        ("abcdefg", 2), ("abcdefgh", 20), ("abcdefghi", 200), ("abcdefghij", 2000),
        ("zzzzzzz", 10), ("zzzzzza", 100), ("zzzzzzb", 100), ("short", 50), ("rareword", 1), (None, 9),
    ]
    got = told(spelling.variants(spark.createDataFrame(words, "word string, n bigint")))
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij", 2, 1, 20)
    assert got["abcdefghij"] == (None, "abcdefghij", 2000, 1, None)
    assert got["zzzzzzz"][0] == "zzzzzza" and got["zzzzzza"][0] is None
    assert len(got) == 7


def test_odd_rows(spark, odd_documents):
    docs = odd_documents((8, "Wörterbuch wörterbuch WÖRTERBUCH " * 3), (9, "a" * 40_000 + " " + "a" * 40_000))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected = brute_counts(rows)
    got = {r.word: r.n for r in spelling.word_counts(docs).filter("n >= 2").collect()}
    assert got == expected and "Ö" in "".join(got)
    assert told(spelling.spelling_variants(docs)).keys() == expected.keys()
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
