"""The registered query of each operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import bpe, classlm, filteraudit, fingerprint, itq, jaccard, langid, linkgraph, packing, quality, rans
from hirelake.llm import spelling, warc, words
from hirelake.llm.common import landed, remainder, table
from hirelake.session import apply_settings


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    documents = table(spark, sf_dir, "documents")
    return bpe.encode_and_decode(documents, path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    return langid.predict(documents, langid.fit(documents, ~held_out)).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


#: Scores from here on predict label 1.
QUALITY_THRESHOLD = 0.3


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    model = quality.fit(documents, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(documents, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, folder = warc.write_pages(table(spark, sf_dir, "pages"))
    return warc.read_records(files, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM r
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = words.encode_words(table(spark, sf_dir, "documents"), path, end_id=1)
    return packing.pack_documents(ids)


def op8_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE e AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), u AS (
    SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e
    WHERE label IS NOT NULL AND v IS NOT NULL AND len([x FOR x IN v IF x IS NULL]) = 0
      AND len([x FOR x IN v IF NOT isfinite(x)]) = 0 AND list_dot_product(v, v) > 0
), l AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b
      ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93
), reach(x, y) AS (
    SELECT x, y FROM l UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x
), n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x),
low AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links,
       least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) AS kept
FROM e LEFT JOIN n ON e.vec_id = n.x LEFT JOIN low ON e.vec_id = low.x
"""


def op10_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages"))


def op9_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = words.encode_words(table(spark, sf_dir, "documents"), path, end_id=2)
    return rans.read_digests(rans.write_ids(landed(ids, "ids")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (
    SELECT w.doc_id, part, coalesce(l.quality, 0) = 1 AS good, coalesce(l.toxic, 0) = 1 AS toxic,
           [len(words) < 100,
            100 * len(list_distinct(words)) < 80 * len(words),
            100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
            regexp_matches(t, '[#$%&*|]'),
            w.doc_id > min(w.doc_id) OVER (PARTITION BY t)] AS x
    FROM w LEFT JOIN labels l ON w.doc_id = l.doc_id
), c AS (SELECT part, good, toxic, x, count(*) AS n FROM f GROUP BY ALL),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a, unnest([1, 2, 3, 4, 5]) AS k),
orders AS (
    SELECT p.a || q.a || r.a || s.a || u.a AS filter_order, [p.k, q.k, r.k, s.k, u.k] AS ks
    FROM one p, one q, one r, one s, one u
    WHERE len(list_distinct([p.k, q.k, r.k, s.k, u.k])) = 5
), steps AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
told AS (
    SELECT part, filter_order, step, ks[step] AS k, good, toxic, n,
           x[ks[step]] AS fails, list_bool_or([x[i] FOR i IN ks[:step - 1]]) AS before,
           list_count([v FOR v IN x IF v] ) AS all_fails
    FROM c, steps
), sums AS (
    SELECT part, filter_order, step, any_value(k) AS k,
           sum(n) FILTER (NOT fails AND NOT coalesce(before, false)) AS kept,
           sum(n) FILTER (fails AND NOT coalesce(before, false)) AS removed,
           sum(n) FILTER (fails AND coalesce(before, false)) AS redundant,
           sum(n) FILTER (fails AND all_fails = 1) AS unique_fails,
           sum(n) FILTER (fails AND NOT coalesce(before, false) AND good) AS good_lost,
           sum(n) FILTER (fails AND NOT coalesce(before, false) AND toxic) AS toxic_lost
    FROM told GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept,
       coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM sums
"""


def op13_classlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 10) == 0
    model, counts = classlm.fit(documents, ~held_out)
    return classlm.score(documents, model, counts, F.col("doc_id"), held_out.alias("held_out"))


#: Name -> (query, SQL or None).
ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_bpe": (op1_bpe, None),
    "op2_jaccard": (op2_jaccard, None),
    "op3_fingerprint": (op3_fingerprint, None),
    "op4_langid": (op4_langid, None),
    "op6_quality": (op6_quality, None),
    "op5_warc": (op5_warc, OP5_SQL),
    "op7_packing": (op7_packing, None),
    "op8_itq": (op8_itq, OP8_SQL),
    "op9_rans": (op9_rans, None),
    "op10_linkgraph": (op10_linkgraph, None),
    "op11_spelling": (op11_spelling, None),
    "op12_filteraudit": (op12_filteraudit, OP12_SQL),
    "op13_classlm": (op13_classlm, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def prepared(build):
        return lambda spark, sf_dir: build(apply_settings(spark), sf_dir)

    return {name: prepared(build) for name, (build, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
