"""Keys seen so far in levels, so that a mark reads little of a long history.

The newest marks are small runs of their own (level 0).  When there are
``FANOUT`` of them they are merged into level 1, and a level that has grown
beyond its capacity into the next; each level beyond 0 is one table, bucketed by
key, ``FANOUT`` times as large as the one before.  So the number of tables, and
of files, grows with the logarithm of the history.

Every level has a Bloom filter, a table of blocks of 2^15 bits.  A key meets the
one block of each level that its hash names; most keys that are new are told so
by the bits, and only the others meet the keys themselves.

What is valid is said by a manifest, a small file of a new number that appears by
a rename.  A mark is therefore there as a whole or not at all: tried again under
its number, it returns its rows without work.  Tables of older manifests are
removed some versions later.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions import dates
from hirelake.operators.cleaning import first_wins
from hirelake.operators.novelty import keyed, seen_count
from hirelake.schema import SEEN
from hirelake.session import written

FANOUT = 8
#: Rows that level 1 holds before it is merged into level 2.
FIRST_LEVEL_ROWS = 1 << 20
#: Keys of a filter block, and bits that a key sets in it: about one wrong guess in a hundred.
BLOCK_KEYS, PROBES = 3_000, 5
BLOCK_BITS = 1 << 15
#: Older manifests that stay readable, with their tables.
VERSIONS_KEPT = 3
#: Marks whose numbers are remembered, to know one that is tried again.
MARKS_KEPT = 1_000
ROW = f"{SEEN}, seq BIGINT"
COLUMNS = [c.split()[0] for c in SEEN.split(", ")]


@dataclass
class Table:
    """A folder of rows: of one mark (level 0) or of a whole level."""

    name: str
    level: int
    rows: int
    blocks: int = 0


@dataclass
class Manifest:
    version: int = 0
    next_seq: int = 0
    tables: list[Table] = field(default_factory=list)
    #: Number of a mark -> its sequence number, newest last.
    marks: dict[str, int] = field(default_factory=dict)
    #: Sequence numbers whose rows do not count.
    forgotten: list[int] = field(default_factory=list)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(text: str) -> Manifest:
        told = json.loads(text)
        return Manifest(**{**told, "tables": [Table(**t) for t in told["tables"]]})


class Folder:
    """Small files in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; it appears whole.  False if another was first."""
        draft = self._at(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.exists(self._at(name)) and self.fs.rename(draft, self._at(name)):
            return True
        self.fs.delete(draft, False)
        return False

    def drop(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def _probes(key: Column) -> Column:
    """The bits that a key sets in its block."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(PROBES)),
        lambda i: F.pmod(F.xxhash64(key, i), F.lit(BLOCK_BITS)),
    )


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), blocks).cast("bigint")


def filter_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """``block`` and ``bits``: the filter of distinct ``dedup_key``s in so many blocks."""
    key = F.col("dedup_key")
    bits = keys.select(_block(key, F.lit(blocks)).alias("block"), F.explode(_probes(key)).alias("bit"))
    return bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


class LevelledSeen:
    """A table of seen keys below ``path``; ``name`` opens its tables' names in the session."""

    def __init__(
        self,
        spark: SparkSession,
        name: str,
        path: str,
        buckets: int = 64,
        fanout: int = FANOUT,
        first_level_rows: int = FIRST_LEVEL_ROWS,
    ):
        self.spark, self.name, self.path, self.buckets = spark, name, path.rstrip("/"), buckets
        self.fanout, self.first_level_rows = fanout, first_level_rows
        self.folder = Folder(spark, self.path)

    def create(self) -> LevelledSeen:
        """Begin an empty table if there is none."""
        if not self._versions():
            self._swap(Manifest())
        return self

    # What is valid

    def _versions(self) -> list[str]:
        return [n for n in self.folder.names("manifest") if n.endswith(".json")]

    def manifest(self) -> Manifest:
        return Manifest.of(self.folder.read(f"manifest/{self._versions()[-1]}"))

    def _swap(self, after: Manifest) -> None:
        """Make a manifest the valid one; fails if another writer was first."""
        after.version += 1
        if not self.folder.put(f"manifest/{after.version:012d}.json", after.text()):
            raise RuntimeError(f"{self.path}: version {after.version} was written by another mark")
        self._sweep()

    def _sweep(self) -> None:
        """Remove old manifests, and tables that no kept one names and that one removed did."""
        versions = self._versions()
        old, kept = versions[:-VERSIONS_KEPT], versions[-VERSIONS_KEPT:]
        if not old:
            return
        valid = {t.name for v in kept for t in Manifest.of(self.folder.read(f"manifest/{v}")).tables}
        for version in old:
            for table in Manifest.of(self.folder.read(f"manifest/{version}")).tables:
                if table.name not in valid:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table.name}")
                    self.folder.drop(f"rows/{table.name}")
                    self.folder.drop(f"filters/{table.name}")
            self.folder.drop(f"manifest/{version}")

    # Reading

    def _rows(self, table: Table, spark: SparkSession) -> DataFrame:
        """A level is read as a bucketed table, so that its side of a join does not move."""
        place = f"{self.path}/rows/{table.name}"
        if not table.level:
            return spark.read.schema(ROW).parquet(place)
        known = f"{self.name}_{table.name}"
        if not spark.catalog.tableExists(known):
            spark.sql(
                f"CREATE TABLE {known} ({ROW}) USING parquet"
                f" CLUSTERED BY (dedup_key) INTO {self.buckets} BUCKETS LOCATION '{place}'"
            )
        return spark.table(known)

    def _recent(self, now: Manifest, spark: SparkSession) -> DataFrame:
        places = [f"{self.path}/rows/{t.name}" for t in now.tables if not t.level]
        return spark.read.schema(ROW).parquet(*places) if places else spark.createDataFrame([], ROW)

    def _valid(self, rows: DataFrame, now: Manifest) -> DataFrame:
        return rows.filter(~F.col("seq").isin(now.forgotten)) if now.forgotten else rows

    def read(self) -> DataFrame:
        now = self.manifest()
        rows = self._recent(now, self.spark)
        for table in now.tables:
            if table.level:
                rows = rows.unionByName(self._rows(table, self.spark))
        return self._valid(rows, now).select(*COLUMNS)

    def known_keys(self, keys: DataFrame, now: Manifest | None = None) -> DataFrame:
        """Those of the distinct ``dedup_key``s that have been seen."""
        spark = keys.sparkSession
        now = now or self.manifest()
        found = self._valid(self._recent(now, spark), now).join(keys, "dedup_key").select("dedup_key")
        levels = [t for t in now.tables if t.level and t.rows]
        if levels:
            likely = written(self.likely_keys(keys, levels), "likely-keys")
            for table in levels:
                asked = likely.filter(F.col("level") == table.level).select("dedup_key")
                held = self._valid(self._rows(table, spark), now).select("dedup_key")
                found = found.unionByName(held.join(asked, "dedup_key"))
        return found.distinct()

    def likely_keys(self, keys: DataFrame, levels: list[Table]) -> DataFrame:
        """``dedup_key`` and ``level`` where the level's filter does not rule the key out."""
        spark = keys.sparkSession
        sizes = F.array(*(F.struct(F.lit(t.level).alias("level"), F.lit(t.blocks).alias("blocks")) for t in levels))
        asked = keys.select("dedup_key", F.explode(sizes).alias("x")).select(
            "dedup_key", "x.level", _block(F.col("dedup_key"), F.col("x.blocks")).alias("block")
        )
        filters = None
        for table in levels:
            blocks = spark.read.parquet(f"{self.path}/filters/{table.name}")
            blocks = blocks.withColumn("level", F.lit(table.level))
            filters = blocks if filters is None else filters.unionByName(blocks)
        hit = F.forall(_probes(F.col("dedup_key")), lambda bit: is_set(F.col("bits"), bit))
        return asked.join(filters, ["level", "block"]).filter(hit).select("dedup_key", "level")

    # Writing

    def mark(self, postings: DataFrame, as_of, run_id: int) -> DataFrame:
        """Insert the unseen keys of a batch under a number; return exactly these rows.

        Under a number that is marked already, the rows of that mark are
        returned and nothing is written.
        """
        spark = postings.sparkSession
        now = self.manifest()
        if str(run_id) in now.marks:
            return self.marked(run_id, spark)
        now = self._merged(now, spark)
        firsts = written(
            first_wins(keyed(postings)).select("dedup_key", "title", "company", "url"), "batch-keys"
        )
        # Written, so that few known keys are broadcast and the batch's rows do not move again.
        known = written(self.known_keys(firsts.select("dedup_key"), now), "known-keys")
        fresh = firsts.join(known, "dedup_key", "left_anti").select(
            "dedup_key",
            "title",
            "company",
            "url",
            dates.instant(as_of).alias("first_seen_at"),
            F.lit(int(run_id)).cast("bigint").alias("run_id"),
            F.lit(now.next_seq).cast("bigint").alias("seq"),
        )
        table = Table(f"mark_{uuid.uuid4().hex}", 0, 0)
        fresh.write.parquet(f"{self.path}/rows/{table.name}")
        rows = self._rows(table, spark)
        table.rows = rows.count()
        now.tables.append(table)
        now.marks[str(run_id)] = now.next_seq
        now.marks = dict(list(now.marks.items())[-MARKS_KEPT:])
        now.next_seq += 1
        self._swap(now)
        return rows.select(*COLUMNS)

    def marked(self, run_id: int, spark: SparkSession | None = None) -> DataFrame:
        """The rows of a remembered mark."""
        spark, now = spark or self.spark, self.manifest()
        seq = now.marks[str(run_id)]
        rows = self._recent(now, spark)
        for table in now.tables:
            if table.level:
                rows = rows.unionByName(self._rows(table, spark))
        return self._valid(rows, now).filter(F.col("seq") == seq).select(*COLUMNS)

    def unmark(self, run_id: int, spark: SparkSession | None = None) -> None:
        """Forget the keys of a mark; its number is free again.  Rows go at the next merge."""
        now = self.manifest()
        seq = now.marks.pop(str(run_id), None)
        if seq is not None:
            now.forgotten.append(seq)
            self._swap(now)

    def _merged(self, now: Manifest, spark: SparkSession) -> Manifest:
        """The manifest with level 0 merged into the levels, if there are enough marks.

        Nothing is valid before the manifest of the mark that asked for it.
        """
        if sum(not t.level for t in now.tables) < self.fanout:
            return now
        by_level = {t.level: t for t in now.tables if t.level}
        merged = [t for t in now.tables if not t.level]
        rows, level, capacity = sum(t.rows for t in merged), 1, self.first_level_rows
        while True:
            if level in by_level:
                merged.append(by_level.pop(level))
                rows += merged[-1].rows
            if rows <= capacity:
                break
            level, capacity = level + 1, capacity * self.fanout
        parts = [self._rows(t, spark) for t in merged if t.rows]
        union = spark.createDataFrame([], ROW)
        for part in parts:
            union = union.unionByName(part)
        table = Table(f"level{level}_{uuid.uuid4().hex}", level, 0)
        place = f"{self.path}/rows/{table.name}"
        # A forgotten key may be there again under a later mark; the rows that count are unique.
        self._rows(table, spark)
        valid = self._valid(union, now)
        valid.repartition(self.buckets, "dedup_key").sortWithinPartitions("dedup_key").write.insertInto(
            f"{self.name}_{table.name}"
        )
        kept = spark.read.schema(ROW).parquet(place)
        table.rows = kept.count()
        table.blocks = max(1, -(-table.rows // BLOCK_KEYS))
        filter_blocks(kept, table.blocks).write.parquet(f"{self.path}/filters/{table.name}")
        left = {t.level: t for t in by_level.values()}
        now.tables = [left[k] for k in sorted(left)] + [table]
        # Levels that were not merged may still hold forgotten rows.
        now.forgotten = now.forgotten if left else []
        return now

    def count(self) -> DataFrame:
        return seen_count(self.read())

    def reset(self) -> None:
        """Begin again without rows, in one step; numbers of earlier marks are free again."""
        now = self.manifest()
        self._swap(Manifest(version=now.version, next_seq=now.next_seq))
