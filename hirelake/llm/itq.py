"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Unit vectors are rotated so that the signs of their coordinates make balanced
binary codes (the rotation is learned from at most ``SAMPLE`` vectors).  A code
is cut into ``TABLES`` parts, and each part is filed once for every one of its
bits, with that bit left out: two codes meet if some part differs in one bit at
most.  Codes that meet and differ in ``RADIUS`` bits at most are tied, tied
vectors form a cell, and all vectors of a cell are compared by their cosine in
double precision, two blocks at a time.  No pair is ever a row: a block pair
reports numbers of links and a spanning forest of them.  All joins are merged: the
optimizer would judge codes by the file they are exploded from, and broadcast them.

Vectors link only within a label.  Null labels and vectors that are null, zero
or hold a null or a non-finite component link with nothing.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import by_group, landed, spread
from hirelake.llm.components import block_pairs, blocks_of, components, in_pairs

THRESHOLD = 0.93
SAMPLE = 10_000
ROUNDS = 50
BITS = 64
TABLES = 4
RADIUS = 16
#: Codes and vectors of a block: a member of a large group is sent once for each of its blocks.
BLOCK = 4096
#: Rows and columns of a block pair that are compared at once.
TILE = 512
#: Buckets of up to so many codes are compared side by side with all others of a batch.
FEW = 32
_UNIT = ["bucket", "left", "right"]


def usable(embedding: str, label: str) -> Column:
    """Whether a vector may link."""
    finite = F.forall(
        F.col(embedding),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    some = F.exists(F.col(embedding), lambda x: x != 0)
    return F.coalesce(F.col(label).isNotNull() & finite & some, F.lit(False))


def learn(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) whose signs are the code.

    Principal axes, then the rotation that brings them nearest to the corners
    of a cube, found by turns: best corners for a rotation, best rotation for
    the corners.  With fewer dimensions than bits there are as many bits as
    dimensions.
    """
    mean = sample.mean(axis=0)
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=False)
    axes = axes[: min(bits, len(axes))].T
    flat = (sample - mean) @ axes
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))[0]
    for _ in range(rounds):
        corners = np.where(flat @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(corners.T @ flat)
        turn = (u @ v).T
    return mean, axes @ turn


def _units(column: pa.ListArray) -> np.ndarray:
    """Unit vectors of lists of one length."""
    rows = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    # Scaled first: the square of a large component need not be finite.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def codes(vectors: DataFrame, projections: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``node``, ``label``, ``size`` and ``code`` of usable vectors."""

    def run(batches):
        for batch in batches:
            sizes = np.array(batch.column(2).to_pylist())
            code = np.zeros(batch.num_rows, np.uint64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                mean, projection = projections[size]
                signs = (_units(batch.column(3).take(pa.array(at))) - mean) @ projection >= 0
                for bit in range(signs.shape[1]):
                    code[at] |= signs[:, bit].astype(np.uint64) << np.uint64(bit)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(code.view(np.int64))], ["node", "label", "size", "code"]
            )

    kind = dict(vectors.dtypes)["label"]
    return vectors.select("node", "label", "size", "embedding").mapInArrow(
        run, f"node bigint, label {kind}, size int, code bigint"
    )


def _split(table: pa.Table):
    """Rows in order of node, the places of both blocks, or None if there is nothing to compare."""
    if table.num_rows < 2:
        return None
    table = table.sort_by("node")
    block = table.column("block").to_numpy()
    left = np.flatnonzero(block == table.column("left")[0].as_py())
    right = np.flatnonzero(block == table.column("right")[0].as_py())
    return (table, left, right) if len(left) and len(right) else None


def _unite(tie: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the groups of linked rows; ``tie`` has the smallest row of each row's group."""
    while True:
        low, high = np.minimum(tie[x], tie[y]), np.maximum(tie[x], tie[y])
        apart = low != high
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        np.minimum.at(tie, high[apart], low[apart])
        while (tie[tie] != tie).any():
            tie[:] = tie[tie]


def _linked(n: int, left: np.ndarray, right: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """How many rows each of ``n`` is linked with, and the smallest row it reaches.

    ``near`` (rows, rows) tells which are linked; it is asked for a tile at a time.
    """
    links, tie = np.zeros(n, np.int64), np.arange(n)
    same = left[0] == right[0]
    for i in range(0, len(left), TILE):
        for j in range(i if same else 0, len(right), TILE):
            a, b = left[i : i + TILE], right[j : j + TILE]
            some = near(a, b)
            own = same and i == j
            if own:
                some |= some.T
                np.fill_diagonal(some, False)
            if some.any():
                links[a] += some.sum(axis=1)
                if not own:
                    links[b] += some.sum(axis=0)
                x, y = np.nonzero(some)
                _unite(tie, a[x], b[y])
    return links, tie


def _tie_codes(table: pa.Table) -> pa.RecordBatch | None:
    parts = _split(table)
    if parts is None:
        return None
    rows, left, right = parts
    code = rows.column("code").to_numpy().view(np.uint64)
    _, tie = _linked(
        len(code), left, right, lambda a, b: np.bitwise_count(code[a][:, None] ^ code[b][None, :]) <= RADIUS
    )
    told = np.flatnonzero(tie != np.arange(len(tie)))
    node = rows.column("node").to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(node[told]), pa.array(node[tie[told]])], ["x", "y"])


def _tie_units(rows: pa.Table, starts: np.ndarray):
    """Ties of the units of work that begin at ``starts``: of few codes all, else a forest."""
    left, right, node = (rows.column(c).to_numpy() for c in ("left", "right", "node"))
    code = rows.column("code").to_numpy().view(np.uint64)
    sizes = np.diff(np.append(starts, len(node)))
    few = (sizes <= FEW) & (left[starts] == right[starts])
    unit = np.where(few, np.arange(len(starts)), -1).repeat(sizes)
    found = []
    for apart in range(1, sizes[few].max(initial=1)):
        at = np.flatnonzero((unit[apart:] == unit[:-apart]) & (unit[apart:] >= 0))
        at = at[np.bitwise_count(code[at] ^ code[at + apart]) <= RADIUS]
        found.append((node[at], node[at + apart]))
    if found:
        x, y = (pa.array(np.concatenate(ends)) for ends in zip(*found))
        yield pa.RecordBatch.from_arrays([x, y], ["x", "y"])
    for n in np.flatnonzero(~few):
        out = _tie_codes(rows.slice(starts[n], sizes[n]))
        if out is not None:
            yield out


def _tie_batches(batches):
    """Ties within each unit of work, from batches sorted by unit.

    A group may spread over batches; no more than one group is held at once
    beside the batch at hand.
    """
    held = None
    for batch in chain(batches, [None]):
        tables = [held] if held else []
        if batch is not None:
            tables.append(pa.Table.from_batches([batch]))
        rows = pa.concat_tables(tables).combine_chunks() if tables else None
        if not rows:
            continue
        keys = [rows.column(c).to_numpy() for c in _UNIT]
        new = np.any([key[1:] != key[:-1] for key in keys], axis=0)
        starts = np.append(0, np.flatnonzero(new) + 1)
        end = rows.num_rows if batch is None else starts[-1]
        held = rows.slice(end)
        yield from _tie_units(rows.slice(0, end), starts[starts < end])


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.RecordBatch | None:
        parts = _split(table)
        if parts is None:
            return None
        rows, left, right = parts
        unit = _units(rows.column("embedding").combine_chunks())
        links, tie = _linked(len(unit), left, right, lambda a, b: unit[a] @ unit[b].T >= threshold)
        told = links > 0
        node = rows.column("node").to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array(node[told]), pa.array(node[tie][told]), pa.array(links[told])],
            ["node", "tie", "links"],
        )

    return run


def near_vectors(
    embeddings: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every vector.

    ``n_links``: other vectors linked directly; ``component_id``: the smallest
    key reachable by links; ``kept``: it is the key itself.  Keys are unique or
    repeat whole rows, which count once; rows with a null key are left out.
    Should a key have several vectors, the first of them in order is taken.
    """
    # Floats stay what they are until they are compared: half as much to move.
    kind = "array<float>" if dict(embeddings.dtypes)[embedding] == "array<float>" else "array<double>"
    vector = F.struct(F.col(label).alias("label"), F.col(embedding).cast(kind).alias("embedding"))
    valid = F.when(usable(embedding, label), vector)
    rows = landed(
        embeddings.filter(F.col(key).isNotNull())
        .select(F.col(key).cast("bigint").alias("node"), valid.alias("v"))
        .groupBy("node")
        .agg(F.min("v").alias("v"))
        .select("node", "v.label", "v.embedding", F.size("v.embedding").alias("size")),
        "vectors",
    )
    good = rows.filter(F.col("embedding").isNotNull())
    projections = {}
    for r in good.groupBy("size").agg(F.count("*").alias("n")).collect():
        part = F.pmod(F.xxhash64("node", F.lit(23)), F.lit(1 << 20)) < int(min(1.0, SAMPLE / r.n) * (1 << 20))
        sample = good.filter((F.col("size") == r["size"]) & part).select("embedding").toArrow()
        if sample.num_rows < 2:
            sample = good.filter(F.col("size") == r["size"]).select("embedding").limit(2).toArrow()
        projections[r["size"]] = learn(_units(sample.column(0).combine_chunks()))
    coded = landed(codes(good, projections), "codes")
    # A part of the code without one of its bits, for each bit: one key of a bucket.
    width = BITS // TABLES
    part_of = [((1 << width) - 1) << (t * width) for t in range(TABLES)]
    masks = [part_of[b // width] & ~(1 << b) for b in range(BITS)]
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]
    filed = coded.select(
        "node",
        "code",
        F.explode(
            F.array(
                *(
                    F.xxhash64("label", "size", F.lit(b), F.col("code").bitwiseAND(F.lit(m)))
                    for b, m in enumerate(signed)
                )
            )
        ).alias("bucket"),
    )
    met = block_pairs(filed, "bucket", "node", BLOCK)
    ties = spread(met, *_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(_tie_batches, "x bigint, y bigint")
    cells = components(ties).withColumnRenamed("component", "cell")
    # Vectors join before a row becomes one for each block.
    celled = blocks_of(landed(cells, "cells"), "cell", BLOCK).join(
        good.select("node", "embedding").hint("merge"), "node"
    )
    work = in_pairs(celled, "node")
    found = landed(
        by_group(work, ["cell", "left", "right"], _compare(threshold), "node bigint, tie bigint, links bigint"),
        "links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("node").alias("x"), F.col("tie").alias("y")))
    component = F.coalesce("component", "node")
    return (
        rows.select("node")
        .join(links.hint("merge"), "node", "left")
        .join(groups.hint("merge"), "node", "left")
        .select(
            F.col("node").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            component.alias("component_id"),
            (F.col("node") == component).alias("kept"),
        )
    )
