"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of ``documents``; other columns are
left behind.  Stages judge rows, not keys: rows without a doc_id, and rows that
repeat one, are judged by their own texts.  An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import jaccard, langid, packing, quality, words
from hirelake.llm.common import landed, table
from hirelake.session import apply_settings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is less certain than this is rejected.
LANGUAGE_CERTAINTY = 0.5
#: A document that scores lower is rejected.
QUALITY_SCORE = 0.3
END_ID = 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known and certain."""
    apply_settings(spark)
    model = langid.fit(docs, F.lit(True))
    told = langid.annotate(docs.select(*COLUMNS), model)
    return told.filter(
        (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_CERTAINTY)
    ).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score like those labelled 1."""
    apply_settings(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    told = quality.annotate(docs.select(*COLUMNS), model)
    return told.filter(F.col("score") >= QUALITY_SCORE).select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that with the smallest doc_id.

    A row without a doc_id stays only where its whole group has none.  Equal rows
    are copies of each other, so one of them stays.  A text without n-grams, null
    and empty ones among them, is no copy of anything.
    """
    apply_settings(spark)
    # Numbers of its own, written down, tell rows apart whatever their keys are.
    rows = landed(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = jaccard.near_copies(rows, key="_row").select("_row", "group_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("keyless"), "doc_id", "_row"))
    kept = groups.join(rows.select("_row", "doc_id"), "_row").groupBy("group_id").agg(first.alias("first"))
    copies = groups.select("_row").join(kept.select("first._row"), "_row", "left_anti")
    return rows.join(landed(copies, "copies"), "_row", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all pieces of the documents in sequences of 4096 ids."""
    apply_settings(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = words.encode_words(docs, path, END_ID, remembered=words.REMEMBERED_IN_STAGES)
    return packing.pack_documents(ids)


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_copies", without_copies),
    ("packing", packed),
]

#: A language model and a classifier that learn have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
