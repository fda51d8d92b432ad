"""Row positions within a group without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hirelake.session import written


def running_position(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    chunk: Column,
    name: str = "position",
) -> DataFrame:
    """Add the 0-based position of each row within ``keys``, in ``order_by``.

    ``chunk`` must never decrease along ``order_by``.  Rows are only sorted
    within one chunk; what precedes a chunk is a running sum over the table of
    chunk sizes.  A group that holds a third of all rows is therefore spread
    over as many tasks as it has chunks.
    """
    rows, inside = in_chunks(df, keys, order_by, chunk)
    placed = rows.withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
    return placed.drop("_group", "_offset")


def in_chunks(
    df: DataFrame, keys: list[str], order_by: list[str], chunk: Column, tasks: int | None = None
) -> tuple[DataFrame, WindowSpec]:
    """Rows with ``_group``, their keys and chunk, and ``_offset``, the rows of the
    keys before the chunk; and the window over a group.

    The group is one column: null keys and chunks are groups like others, and the
    join and all windows over it share the one exchange that a row goes through,
    into ``tasks`` partitions where that is given.
    """
    tagged = df.withColumn("_group", F.struct(*keys, chunk.alias("_chunk")))
    sizes = tagged.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    before = (
        Window.partitionBy(*(F.col("_group")[key] for key in keys))
        .orderBy(F.col("_group")["_chunk"])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select("_group", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    if tasks:
        tagged, offsets = (rows.repartition(tasks, "_group") for rows in (tagged, offsets))
    return tagged.join(offsets, "_group"), Window.partitionBy("_group").orderBy(*order_by)


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt by range of ``order`` and written in it, with ``_id``: the upper
    bits are the partition, the lower ones the row in it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranged")


def ranged_position(df: DataFrame, keys: list[str], order_by: list[str], name: str = "position") -> DataFrame:
    """:func:`running_position` without a chunk: range partitions numbered by counts.

    Rows are dealt by range of (keys, order) and written in that order, so a hot
    key is as many tasks as it fills.  What goes before a partition's rows of a
    key follows from the counts of the partitions, a row per key and partition
    that holds it.  Rows that agree in keys and order get places of their own,
    in any order among themselves.
    """
    rows = ranged(df, [*keys, *order_by])
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(*keys, part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first")
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *(F.col(k).alias(f"_of_{k}") for k in keys),
        F.col("_part").alias("_of_part"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_offset"),
    )
    same = part == F.col("_of_part")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    placed = rows.join(offsets, same).withColumn(name, F.col("_offset") + F.col("_id"))
    return placed.drop("_id", "_offset", "_of_part", *[f"_of_{key}" for key in keys])
