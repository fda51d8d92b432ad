"""Connected components, and the comparison of all members of a group in blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import landed

#: Members of a block; two blocks are compared in one task.
BLOCK = 256


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("x", "y")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) from edges ``x``, ``y``.

    Large-star and small-star steps in turn, until the edges are stars around
    the smallest node of each component: a logarithmic number of rounds.  Both
    are minima by node, pre-aggregated before the shuffle, and a join; each
    round is written to the shared folder.  Nodes without an edge to another
    are not in the result; null ends are left out.  Both sides of a join grow with
    the edges, so they are merged at every size and none goes through the driver.
    """

    def lowest(pairs: DataFrame) -> DataFrame:
        """``node``, ``low``: the smallest of a node and its neighbours."""
        return pairs.groupBy("node").agg(F.min("other").alias("low")).select(
            "node", F.least("node", "low").alias("low")
        )

    def ordered(pairs: DataFrame) -> DataFrame:
        return (
            pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
            .filter(F.col("x") != F.col("y"))
            .distinct()
        )

    now = landed(ordered(edges.filter(F.col("x").isNotNull() & F.col("y").isNotNull())), "edges")
    state = _state(now)
    while state[0]:
        # Large star: larger neighbours of a node to its smallest neighbour.
        down = now.select(F.col("x").alias("node"), F.col("y").alias("other"))
        up = now.select(F.col("y").alias("node"), F.col("x").alias("other"))
        large = ordered(
            up.join(lowest(down.unionByName(up)).hint("merge"), "node").select(
                F.col("other").alias("x"), F.col("low").alias("y")
            )
        )
        large = landed(large, "edges")
        # Small star: a node and its smaller neighbours to the smallest of them.
        down = large.select(F.col("x").alias("node"), F.col("y").alias("other"))
        low = lowest(down)
        small = down.join(low.hint("merge"), "node").select(F.col("other").alias("x"), F.col("low").alias("y"))
        now = landed(
            ordered(small.unionByName(low.select(F.col("node").alias("x"), F.col("low").alias("y")))),
            "edges",
        )
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(
        now.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    )


def blocks_of(members: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """Members of groups of two at least, with ``blocks``: how many their group is dealt into.

    ``members`` is used twice.  It may hold many more rows than the file it is made
    from tells the optimizer, so it is merged with the sizes at any size.
    """
    n = F.count("*")
    sizes = members.groupBy(group).agg(n.alias("n"), F.ceil(n / block).cast("bigint").alias("blocks"))
    return members.join(sizes.filter("n > 1").drop("n").hint("merge"), group)


def in_pairs(members: DataFrame, member: str) -> DataFrame:
    """Members that have ``blocks``, once for each pair of blocks they take part in."""
    own = F.pmod(F.xxhash64(member, F.lit(5)), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    return (
        members.withColumn("block", own)
        .withColumn("with", other)
        .withColumn("left", F.least("block", "with"))
        .withColumn("right", F.greatest("block", "with"))
        .drop("blocks", "with")
    )


def block_pairs(members: DataFrame, group: str, member: str, block: int = BLOCK) -> DataFrame:
    """Members with ``left``, ``right`` and ``block``: which pairs of blocks they take part in.

    A group is dealt into blocks of about ``block`` members by a hash; every
    pair of blocks of a group, and each block with itself, is one unit of work
    keyed by (group, left, right).  A small group is one block.  So all members
    of a group meet, however large it is, and no task holds more than two
    blocks.  A group of one has no pairs.  ``members`` is used twice.
    """
    return in_pairs(blocks_of(members, group, block), member)


def smallest_reachable(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row it reaches."""
    label = np.arange(len(linked))
    while True:
        best = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        after = np.minimum(label, best)
        after = np.minimum(after, after[after])
        if (after == label).all():
            return label
        label = after
