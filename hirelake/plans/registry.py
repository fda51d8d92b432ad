"""All registered queries by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hirelake.plans.views import Inputs

MODULES = [
    "checks_cleaning",
    "checks_catalog",
    "checks_payloads",
    "checks_pages",
    "checks_models",
    "checks_reports",
    "checks_run",
    "checks_seen",
    "checks_exchange",
    "checks_landing",
]


def _all() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for module in MODULES:
        found.update(importlib.import_module(f"hirelake.plans.{module}").QUERIES)
    return found


def builders() -> dict[str, Callable[[Inputs], DataFrame]]:
    return {name: build for name, (build, _) in _all().items()}


def _on_folder(build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Inputs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _on_folder(build) for name, build in builders().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
