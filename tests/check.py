"""Run registered queries against their SQL: ``python tests/check.py DIR [name ...]``."""

from __future__ import annotations

import importlib
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import compare, duck

import __spark_entry__ as contract
from hirelake.session import build_session


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "check",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sql = contract.queries(), contract.oracle_sql()
    bad = 0
    if names and names[0].startswith("@"):
        names = list(importlib.import_module(f"hirelake.plans.checks_{names[0][1:]}").QUERIES) + names[1:]
    for name in names or queries:
        started = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            told = compare(frame, con, sql[name]) if name in sql else f"no SQL, {frame.count()} rows"
        except Exception as error:
            told = f"{type(error).__name__}: {str(error)[:700]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += told is not None
        print(f"{'ok ' if told is None else 'BAD'} {name} {time.time() - started:.1f}s {told or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
