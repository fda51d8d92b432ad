import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns with the operators' names."""

    def build(*more):
        rows = [
            (1, "The cat sat on the mat, and then it slept all day long."),
            (2, None),
            (3, ""),
            (4, "   \n\t "),
            (None, "Nobody knows the key of this short text."),
            (5, "word " * 30_000),
            (6, "The cat sat on the mat, and then it slept all day long."),
            (6, "The cat sat on the mat, and then it slept all day long."),
            (7, "12 + 34 = 46 !!! 漢字 🙂 naïve Straße"),
            *more,
        ]
        filled = [(*r, "en", "x", 0.5, 1, 2, "bands", "key") for r in rows]
        return spark.createDataFrame(
            filled,
            "doc_id bigint, text string, lang string, source string, score double, ids int,"
            " node int, digest string, key string",
        )

    return build
