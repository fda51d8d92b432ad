import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from hirelake.llm import jaccard, words

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, score double, _row int, node string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def texts(n, salt="w"):
    return " ".join(f"{salt}{n}x{i}" for i in range(60))


def frame(spark, *rows):
    return spark.createDataFrame([(k, t, "en", "s", 1, 0.5, 7, "n") for k, t in rows], SCHEMA)


def test_copies_by_rows_not_keys(spark):
    near = texts(2).replace("w2x59", "other")
    rows = [
        (5, texts(1)), (3, texts(1)), (3, texts(1)), (None, texts(1)), (9, texts(2)), (8, near), (8, texts(3)),
        (None, texts(4)), (None, texts(4)), (None, texts(5)), (1, None), (2, None), (1, ""), (4, "12 3"), (4, "12 3"),
        (6, "a" * 50_000), (7, "a" * 50_000),
    ]
    got = pipeline.without_copies(spark, frame(spark, *rows), SF_DIR)
    assert got.columns == pipeline.COLUMNS
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    expected = [
        (3, texts(1)), (8, near), (8, texts(3)), (None, texts(4)), (None, texts(5)), (1, None), (2, None), (1, ""),
        (4, "12 3"), (6, "a" * 50_000),
    ]
    assert kept == sorted(expected, key=str)
    assert pipeline.without_copies(spark, frame(spark, *rows).limit(0), SF_DIR).count() == 0


def test_every_dropped_document_is_a_copy_of_a_kept_one(spark, docs):
    """Brute force: groups of all pairs at the threshold, one row of each stays."""
    hashes = jaccard.WordHashes()
    sets = {r.doc_id: set(jaccard.ngrams(r.text or "", hashes).tolist()) for r in docs.collect()}
    group = {k: k for k in sets}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                    x, y = sorted((root(a), root(b)))
                    group[y] = x
    kept = {r.doc_id for r in pipeline.without_copies(spark, docs, SF_DIR).collect()}
    assert kept == {k for k in sets if root(k) == k}


def test_language_and_quality_judge_rows(spark, docs):
    some = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (0, "", "en", "s", 0), (0, "12 34 !!", "en", "s", 8), (1, None, "en", "s", 0)],
        some.schema,
    )
    more = some.unionByName(odd).unionByName(some).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x"))
    for stage in (pipeline.language, pipeline.good_quality):
        got = stage(spark, more, SF_DIR)
        assert got.columns == pipeline.COLUMNS
        twice = got.filter(F.length("text") > 20).groupBy("doc_id", "text").count()
        # Repeated rows are judged alike: kept together or dropped together.
        assert {r["count"] % 2 for r in twice.collect()} == {0}
    kept = {(r.doc_id, r.text) for r in pipeline.language(spark, more, SF_DIR).collect()}
    assert not kept & {(None, None), (0, ""), (0, "12 34 !!"), (1, None)}
    assert pipeline.language(spark, more.limit(0), SF_DIR).count() == 0
    assert pipeline.good_quality(spark, more.limit(0), SF_DIR).count() == 0


def test_packed_pieces_hold_every_kept_document(spark, docs):
    rows = pipeline.run(spark, SF_DIR).collect()
    kept = docs
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF_DIR)
    own = words.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    length = {r.doc_id: len(own.encode(r.text or "")) // 2 + 1 for r in kept.collect()}
    assert 0 < len(length) < docs.count()
    got, sequences = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got.keys() == length.keys()
    for key, pieces in got.items():
        at = 0
        for n, (piece, start, size) in enumerate(sorted(pieces)):
            assert (piece, start) == (n, at)
            at += size
        assert at == length[key]
    for placed in sequences.values():
        at = 0
        for offset, size in sorted(placed):
            assert offset == at
            at += size
        assert at <= 4096
