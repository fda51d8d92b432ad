"""Reading inputs and landing intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The result has no lineage: a lost executor costs no more than reading a
    file again, and every later use sees the same rows.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt out by keys to as many tasks as the session says.

    With a number given, adaptive execution does not join small partitions:
    few bytes may stand for much work.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def whole_rows(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from batches sorted by them, one table a group.

    A group may spread over batches; no more than one group is held at once
    beside the batch at hand.
    """
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        columns = [rows.column(k).to_pylist() for k in keys]
        start = 0
        for n, key in enumerate(zip(*columns)):
            if key != last:
                if n > start:
                    held.append(rows.slice(start, n - start))
                if held:
                    yield pa.concat_tables(held)
                held, start, last = [], n, key
        held.append(rows.slice(start))
    if held:
        yield pa.concat_tables(held)


def by_group(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """``function`` (table -> record batch or None) over the rows of each key.

    The rows of a key meet in one task, so callers bound them first.  Unlike a
    grouped pandas call this costs microseconds for a group of two rows.
    """

    def run(batches):
        for group in whole_rows(batches, keys):
            out = function(group)
            if out is not None and out.num_rows:
                yield out

    return spread(df, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % divisor, F.lit(-1))


def hash_part(key: str, part) -> Column:
    """True for about that part of the keys, the same ones every time."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 20)) < part * F.lit(1 << 20)
