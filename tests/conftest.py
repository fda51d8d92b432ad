import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from hirelake.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def posting_rows(spark):
    """Postings from (title, company, location, date_posted) in list order."""

    def build(*rows):
        filled = [
            (
                *(tuple(row) + ("", "")[: 4 - len(row)])[:3],
                f"https://example.com/{n}",
                "",
                row[3] if len(row) > 3 else "",
                "src",
                "",
                "p",
                0,
                1,
                n,
            )
            for n, row in enumerate(rows)
        ]
        from hirelake.schema import POSTING

        return spark.createDataFrame(filled, POSTING)

    return build
