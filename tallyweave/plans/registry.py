"""Registry of the relational queries: name -> (query, DuckDB twin)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyweave.plans import calibration, checks, layout, linking, pages, runs, scalar

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (scalar, layout, linking, calibration, checks, runs, pages)


def _all() -> dict[str, tuple]:
    return {name: pair for module in MODULES for name, pair in module.ALL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link_orders_to_parts(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: twin for name, (_, twin) in _all().items() if twin}
