"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads.

The operators read landed tables, so the input views are landed first: each is
written once as Parquet in as many files as there are threads, and the time for
that is reported apart (``landing_sec``).  Then every query runs once unmeasured
and twice measured, the median counts.  Results are written in full to a
sink that discards them, so all columns of all rows are computed.

``BENCH_LANDED=0`` reads the given files and derives the views in every run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import zlib

from hirelake.plans import registry
from hirelake.plans.views import Inputs
from hirelake.session import build_session, scratch_dir

HEADLINE = [
    "clean_postings",
    "drop_counters",
    "dedup_first",
    "mark_seen",
    "new_rows",
    "cycle_new",
    "by_company",
    "summary",
    "recency_counts",
    "search_view",
    "source_status",
    "page_cutoff",
    "flatten_github",
    "flatten_greenhouse",
    "all_postings",
    "page_text",
    "page_links",
    "page_context",
    "model_batches",
    "parse_responses",
    "apply_responses",
    "normalize_rules",
]


class LandedInputs(Inputs):
    """Tables and views read from files written beforehand."""

    def __init__(self, spark, sf_dir: str, files: int):
        super().__init__(spark, sf_dir)
        self.folder, self.files, self.landing_sec = scratch_dir(spark, "bench"), files, 0.0
        self._landed: set[str] = set()

    def _land(self, name: str, build):
        path = f"{self.folder}/{name}"
        if name not in self._landed:
            started = time.perf_counter()
            build().repartition(self.files).write.parquet(path)
            self.landing_sec += time.perf_counter() - started
            self._landed.add(name)
        return self.spark.read.parquet(path)

    def table(self, name: str):
        return self._land(name, lambda: Inputs.table(self, name))

    def view(self, text: str, *tables: str):
        name = f"view-{zlib.crc32(text.encode()):08x}"
        return self._land(name, lambda: Inputs.view(self, text, *tables))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("BENCH_LANDED", "1") == "1":
        inputs = LandedInputs(spark, sf_dir, int(cpus))
    else:
        inputs = Inputs(spark, sf_dir)
    builders = registry.builders()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(repeats + 1):
            started = time.perf_counter()
            builders[name](inputs).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs[1:] or runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
                "landing_sec": round(getattr(inputs, "landing_sec", 0.0), 3),
            }
        )
    )


if __name__ == "__main__":
    main()
