"""What is asked of a model, addressed by its content.

A request, whether a page to read or a batch to normalize, is known by a hash of
what it says.  Answers are kept by that hash, over all cycles: a page that has not
changed and a batch of the same rows are answered already, and what stays open is
asked once however many pages and cycles ask it.  An answer that failed leaves its
request open.

Answers are rows ``ask_id``, ``text``, ``error``; of several to one request any
that did not fail counts, the smallest text of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import blank_to_null, filled, or_empty
from hirelake.operators.model_tables import (
    BATCH_SIZE,
    answer_elements,
    extract_requests,
    is_record,
    model_batches,
    record_checks,
)
from hirelake.schema import ORDINAL, POSTING_FIELDS

EXTRACT, NORMALIZE = "extract", "normalize"
NORMALIZE_HEAD = "Normalize every job posting below."
NORMALIZE_TAIL = "Answer with a JSON array of the same objects and nothing else."
ANSWER = "ask_id STRING, text STRING, error STRING"


def ask_id(kind: str, content: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind + "\n"), content), 256)


def extraction_asks(contexts: DataFrame, flattened: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, source, url, kind, ask_id and request of pages whose source has no
    flattened rows; a page without text has an error instead."""
    made = extract_requests(contexts, flattened, keys)
    return made.withColumns({"kind": F.lit(EXTRACT), "ask_id": ask_id(EXTRACT, F.col("request"))})


def normalization_asks(postings: DataFrame, keys: list[str], size: int = BATCH_SIZE) -> DataFrame:
    """``keys``, batch_id, jobs_json, kind, ask_id and request of consecutive rows of each source."""
    batches = model_batches(postings, None, [c for c in ORDINAL if c not in keys], size, keys)
    request = F.concat(F.lit(NORMALIZE_HEAD + "\n"), F.col("jobs_json"), F.lit("\n" + NORMALIZE_TAIL))
    return batches.withColumns(
        {"kind": F.lit(NORMALIZE), "request": request, "ask_id": ask_id(NORMALIZE, F.col("jobs_json"))}
    )


def _one_each(answers: DataFrame) -> DataFrame:
    """One row a request: an answer that did not fail, else a failure."""
    good = ~filled(F.col("error")) & F.col("text").isNotNull()
    return answers.groupBy("ask_id").agg(
        F.min(F.when(good, F.col("text"))).alias("text"),
        F.min(F.when(~good, or_empty(F.col("error")))).alias("failure"),
    )


def open_asks(asks: DataFrame, answers: DataFrame) -> DataFrame:
    """``ask_id``, ``kind``, ``request``: each request that has no good answer, once."""
    answered = _one_each(answers).filter(F.col("text").isNotNull()).select("ask_id")
    asked = asks.filter(F.col("request").isNotNull()).groupBy("ask_id", "kind").agg(F.min("request").alias("request"))
    return asked.join(answered, "ask_id", "left_anti")


def _read(answers: DataFrame) -> DataFrame:
    """Answers with their elements: each text is read once, however often it was asked for."""
    return _one_each(answers).withColumn("elements", answer_elements(F.col("text"))).drop("text")


def _record_fields(element: Column, source: Column, job_type: Column) -> dict[str, Column]:
    fields = {name: F.try_variant_get(element, f"$.{name}", "string") for name in POSTING_FIELDS}
    fields["source"] = F.coalesce(fields["source"], source)
    fields["job_type"] = F.coalesce(fields["job_type"], job_type)
    return fields


def extracted(asks: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the answers to pages: the source's name is the page's, and a row
    without an address has the page's."""
    rows = asks.filter(F.col("request").isNotNull()).join(_read(answers), "ask_id")
    rows = rows.select(
        *keys, "source", F.col("url").alias("page_url"), F.posexplode("elements").alias("item_no", "element")
    ).filter(is_record(F.col("element")))
    fields = _record_fields(F.col("element"), F.col("source"), F.lit(None))
    fields["source"] = F.col("source")
    fields["url"] = F.coalesce(blank_to_null(fields["url"]), blank_to_null(F.col("page_url")), fields["url"])
    return rows.select(*keys, *(fields[n].alias(n) for n in POSTING_FIELDS), F.col("item_no").cast("bigint"))


def extraction_failures(asks: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, source, error of pages without text, and of those whose request only failed."""
    failed = _one_each(answers).filter(F.col("text").isNull()).select("ask_id", "failure")
    told = F.concat(F.lit("LLM call failed for "), F.col("source"), F.lit(": "), F.col("failure"))
    lost = asks.join(failed, "ask_id").select(*keys, "source", told.alias("error"))
    return lost.unionByName(asks.filter(F.col("error").isNotNull()).select(*keys, "source", "error"))


def normalized(batches: DataFrame, answers: DataFrame, names: Column, keys: list[str]) -> DataFrame:
    """Rows of each batch's answer, or its own rows where that is missing, failed or unreadable.

    An empty list is an answer: no rows.  A row without a source has ``names``, one
    without a kind of work an empty one; ``is_valid`` tells whether an answered
    record has the right types, and whether a row of one's own has a title and a
    company (its other NULLs are absent fields).  Rows that are not valid are
    kept.  ``page_no`` and ``item_no`` are the batch and the place in it.
    """
    own = F.from_json("jobs_json", "ARRAY<VARIANT>")
    rows = (
        batches.join(_read(answers), "ask_id", "left")
        .withColumn("name", names)
        .withColumn("answered", F.col("elements").isNotNull())
        .select(
            *keys, "name", "batch_id", "answered", F.posexplode(F.coalesce("elements", own)).alias("item_no", "element")
        )
        .filter(is_record(F.col("element")))
    )
    fields = _record_fields(F.col("element"), F.col("name"), F.lit(""))
    return rows.select(
        *keys,
        *(fields[n].alias(n) for n in POSTING_FIELDS),
        F.col("batch_id").cast("bigint").alias("page_no"),
        F.col("item_no").cast("bigint").alias("item_no"),
        F.when(F.col("answered"), record_checks(F.col("element")))
        .otherwise(fields["title"].isNotNull() & fields["company"].isNotNull())
        .alias("is_valid"),
    )
