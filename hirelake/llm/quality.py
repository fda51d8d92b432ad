"""Quality by nearest-neighbour voting among latent-semantic vectors.

A text is a bag of token shapes and of pairs of neighbouring shapes: which kinds
of characters a token holds in which order, or that it repeats the token before
it.  Counts are damped, weighted by rarity and reduced to ``DIMENSIONS`` latent
dimensions.  Every text is compared with all labelled vectors, a block at a
time, and the labels of the nearest vote with the cosine as weight.

At most ``SAMPLE`` labelled texts of each label are learned from, chosen by a
hash of their key; the parameter bounds what is broadcast.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import hash_part, whole_text

SAMPLE = 2000
FEATURES = 4096
DIMENSIONS = 64
NEIGHBOURS = 25
#: The power of the cosine by which a neighbour votes.
SHARPNESS = 4
#: Tokens a worker remembers, at most.
REMEMBERED = 400_000
#: Texts compared with the labelled vectors at once.
BLOCK = 256
REPEAT, FIRST, LAST = 1, 2, 3


def shape(token: str) -> str:
    """Kinds of characters in order: X upper, x lower, 9 digit, others as they are."""
    kinds = []
    for c in token:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if kinds[-2:] != [kind, kind]:
            kinds.append(kind)
    return "".join(kinds)


class Shapes(dict):
    """Feature numbers of tokens by their shape."""

    def __missing__(self, token: str) -> int:
        at = 8 + zlib.crc32(shape(token).encode("utf-8", "surrogatepass")) % (FEATURES - 8)
        if len(self) < REMEMBERED:
            self[token] = at
        return at


def counts(text: str, shapes: Shapes) -> np.ndarray:
    """Damped counts of shapes and of pairs of shapes."""
    tokens = text.split()
    if not tokens:
        return np.zeros(FEATURES, np.float32)
    at = np.fromiter(map(shapes.__getitem__, tokens), np.int64, len(tokens))
    again = np.fromiter(map(operator.eq, tokens[1:], tokens), bool, len(tokens) - 1)
    at[1:][again] = REPEAT
    edged = np.concatenate([[FIRST], at, [LAST]])
    pairs = (edged[:-1] * 31 + edged[1:] * 17 + 5) % FEATURES
    n = np.bincount(at, minlength=FEATURES) + np.bincount(pairs, minlength=FEATURES)
    return np.log1p(n).astype(np.float32)


@dataclass
class Model:
    """Rarity of features, latent axes, labelled vectors, their labels and their weights."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        found = (rows * self.rarity) @ self.axes
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Of a block of count rows; the share of label 1 where nothing is alike."""
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        cosine = self.latent(rows) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, 1), 0.0) ** SHARPNESS * self.weights[near]
        total = vote.sum(axis=1)
        found = (vote * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where(total > 1e-9, found, self.prior)


def fit_model(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Model:
    """Latent axes by a randomised decomposition of at most 2 * ``SAMPLE`` rows."""
    if not len(rows):
        none = np.zeros((0, 1), np.float32)
        return Model(np.zeros(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), none, labels, weights, 0.5)
    rarity = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    scaled = rows * rarity
    scaled /= np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-12)
    size = min(DIMENSIONS + 16, *scaled.shape)
    basis = scaled @ np.random.default_rng(7).standard_normal((FEATURES, size)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(scaled @ (scaled.T @ np.linalg.qr(basis)[0]))[0]
    axes = np.linalg.svd(basis.T @ scaled, full_matrices=False)[2][:DIMENSIONS].T.astype(np.float32)
    prior = float((labels * weights).sum() / weights.sum())
    model = Model(rarity, axes, np.empty(0), labels, weights, prior)
    model.vectors = model.latent(rows).astype(np.float32)
    return model


def fit(documents: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id") -> Model:
    """Learn ``quality`` (0 or 1) from the labelled rows where ``usable`` holds.

    A key labelled more than once counts with the mean of its labels, a text
    that is there more than once once for each row.  Null labels and keys are
    left out.
    """
    told = (
        labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull() & usable)
        .groupBy(key)
        .agg(F.avg("quality").alias("label"))
        .withColumn("good", F.col("label") >= 0.5)
    )
    sizes = {r.good: r.n for r in told.groupBy("good").agg(F.count("*").alias("n")).collect()}
    part = {good: min(1.0, SAMPLE / n) for good, n in sizes.items()}
    keep = hash_part(key, F.when(F.col("good"), part.get(True, 0.0)).otherwise(part.get(False, 0.0)))
    # At most about 2 * SAMPLE rows of two numbers.
    chosen = F.broadcast(told.filter(keep).select(key, "label"))

    def run(batches):
        shapes = Shapes()
        for batch in batches:
            rows = [counts(x, shapes) for x in batch.column(1).to_pylist()]
            used = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([u.astype("<u2").tobytes() for u in used], pa.binary()),
                    pa.array([r[u].astype("<f4").tobytes() for r, u in zip(rows, used)], pa.binary()),
                ],
                ["label", "at", "n"],
            )

    texts = documents.select(key, whole_text().alias("text")).join(chosen, key).select("label", "text")
    sample = texts.mapInArrow(run, "label double, at binary, n binary").collect()
    # One order however the rows came: neighbours of equal cosine are taken by it.
    sample.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["n"])))
    rows = np.zeros((len(sample), FEATURES), np.float32)
    for i, r in enumerate(sample):
        rows[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<f4")
    given = np.array([r["label"] for r in sample], np.float64)
    # What a label has lost by sampling, its votes regain.
    weights = np.where(given >= 0.5, 1 / part.get(True, 1.0), 1 / part.get(False, 1.0))
    return fit_model(rows, given, weights)


def annotate(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``documents``, then ``score`` (0 to 1), from the whole text alone.

    Null and empty texts, and all texts when nothing could be learned, get the
    share of label 1 among the labelled rows (0.5 without any).  A column
    ``score`` is replaced.
    """
    documents = documents.drop("score")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns
    at = names.index(text)

    def run(batches):
        own, shapes = shared.value, Shapes()
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                block = batch.slice(start, BLOCK)
                rows = np.stack([counts(x or "", shapes) for x in block.column(at).to_pylist()])
                found = np.clip(own.score(rows), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [*block.columns, pa.array(found, pa.float64())], [*names, "score"]
                )

    return documents.mapInArrow(run, documents.schema.simpleString()[7:-1] + ",score:double")


def score(documents: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key`` and ``score`` of every row; other columns are left behind."""
    told = annotate(documents.select(F.col(key).alias("key"), F.col("text").alias("text")), model)
    return told.select(F.col("key").alias(key), "score")
