"""Language identification, words first.

A word that the model knows scores by its log frequency in each language.  Any
other word falls back to its character n-grams: the longest length of which it
holds a known n-gram decides, and shorter ones are asked only when there is
none.  A text scores the sum over its words.

The model is learned from at most ``DOCUMENTS`` texts per language, chosen by a
hash of their key; this parameter bounds what is broadcast.  It keeps every word
and n-gram that these texts hold at least ``LEAST`` times.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import hash_part, landed, whole_text

DOCUMENTS = 600
#: Rarer entries of the sample are left to the backoff.
LEAST = 2
LONGEST = 5
UNKNOWN = "und"
#: Of a text's words, so many count towards the certainty of its score.
CERTAIN_WORDS = 20
#: Words a worker remembers, at most.
REMEMBERED = 400_000
WORD = re.compile(r"[^\W\d_]+")
#: A word or n-gram that a language lacks counts as this many.
SMOOTHING = 0.5


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its edges marked."""
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counts(sample: DataFrame) -> DataFrame:
    """``lang``, ``kind`` (0: words, else the length of n-grams), ``entry``, ``n``."""

    def run(batches):
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text))
        for lang, counter in words.items():
            for kind in range(LONGEST + 1):
                if kind:
                    found = Counter()
                    for word, times in counter.items():
                        for gram in grams(word, kind):
                            found[gram] += times
                else:
                    found = counter
                size = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * size, pa.string()),
                        pa.array([kind] * size, pa.int32()),
                        pa.array(list(found), pa.string()),
                        pa.array(list(found.values()), pa.int64()),
                    ],
                    ["lang", "kind", "entry", "n"],
                )

    told = sample.select("lang", whole_text().alias("text")).mapInArrow(
        run, "lang string, kind int, entry string, n bigint"
    )
    return told.groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n"))


class Entries(Mapping):
    """Log frequencies by language of the entries of one kind: a place for each
    entry, and one matrix for all, which takes a third of the memory of arrays apart."""

    def __init__(self, counts: dict[str, np.ndarray], langs: int, total: np.ndarray):
        self.place = {entry: i for i, entry in enumerate(counts)}
        rows = np.array(list(counts.values())).reshape(len(counts), langs)
        self.logs = np.log((rows + SMOOTHING) / total).astype(np.float32)

    def __getitem__(self, entry: str) -> np.ndarray:
        return self.logs[self.place[entry]]

    def __iter__(self):
        return iter(self.place)

    def __len__(self) -> int:
        return len(self.place)


class Model:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, langs: list[str], rows: list[tuple[int, str, str, int]], totals: dict):
        self.langs = sorted(langs)
        column = {lang: i for i, lang in enumerate(self.langs)}
        self.known: list[Entries] = []
        for kind in range(LONGEST + 1):
            counts: dict[str, np.ndarray] = {}
            for k, entry, lang, n in rows:
                if k == kind:
                    counts.setdefault(entry, np.zeros(len(column)))[column[lang]] = n
            total = np.array([totals.get((lang, kind), 0) for lang in self.langs], float)
            total += SMOOTHING * (len(counts) + 1)
            self.known.append(Entries(counts, len(column), total))

    def score_word(self, word: str) -> np.ndarray:
        if word in self.known[0].place:
            return self.known[0][word]
        for n in range(LONGEST, 0, -1):
            known = self.known[n]
            hits = [at for g in grams(word, n) if (at := known.place.get(g)) is not None]
            if hits:
                return known.logs[hits].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


def fit(documents: DataFrame, usable: Column, key: str = "doc_id") -> Model:
    """Learn from ``text`` and ``lang`` of the rows where ``usable`` holds and lang is not null."""
    rows = documents.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], [], {})
    part = F.lit(0.0)
    for lang, n in sizes.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, DOCUMENTS / n))).otherwise(part)
    counts = landed(_counts(rows.filter(hash_part(key, part))), "lang-counts")
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()
    often = F.sum("n") >= LEAST
    kept = counts.groupBy("kind", "entry").agg(often.alias("often")).filter("often").drop("often")
    table = counts.join(kept, ["kind", "entry"]).select("kind", "entry", "lang", "n").collect()
    return Model(list(sizes), [tuple(r) for r in table], {(r.lang, r.kind): r.n for r in totals})


class _Scorer:
    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self):
        self.row = {}
        self.table = np.zeros((1 << 12, len(self.model.langs)), np.float32)
        self.used = 1  # row 0: no letter

    def _row(self, word: str) -> int:
        if not any(c.isalpha() for c in word):
            at = 0
        else:
            at, self.used = self.used, self.used + 1
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = self.model.score_word(word)
        self.row[word] = at
        return at

    def predict(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if self.used + len(words) > REMEMBERED:
            self._forget()
        get, add = self.row.get, self._row
        rows = [r if (r := get(w)) is not None else add(w) for w in words]
        n = len(rows) - rows.count(0)
        if not n or not self.model.langs:
            return UNKNOWN, 0.0
        mean = self.table[rows].sum(axis=0, dtype=np.float64) / n
        odds = np.exp((mean - mean.max()) * min(n, CERTAIN_WORDS))
        best = int(odds.argmax())  # the first in alphabetical order among equals
        return self.model.langs[best], float(odds[best] / odds.sum())


def annotate(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``documents``, then ``lang_pred`` and ``score``, from the text alone.

    ``und`` with score 0 for null and empty texts, texts without letters, and
    when nothing could be learned.  Repeated rows are predicted alike.  Columns
    of these two names are replaced.
    """
    documents = documents.drop("lang_pred", "score")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns
    at = names.index(text)

    def run(batches):
        scorer = _Scorer(shared.value)
        for batch in batches:
            told = [scorer.predict(x or "") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([t[0] for t in told], pa.string()),
                    pa.array([t[1] for t in told], pa.float64()),
                ],
                [*names, "lang_pred", "score"],
            )

    return documents.mapInArrow(
        run, documents.schema.simpleString()[7:-1] + ",lang_pred:string,score:double"
    )


def predict(documents: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of every row; other columns are left behind."""
    told = annotate(documents.select(F.col(key).alias("key"), F.col("text").alias("text")), model)
    return told.select(F.col("key").alias(key), "lang_pred", "score")
