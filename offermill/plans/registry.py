"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offermill.plans import catalog, duplicates, feeds, imports, ladders, markets, offers, prices, repairs, series, stores

_ALL = prices.QUERIES | catalog.QUERIES | series.QUERIES | offers.QUERIES | repairs.QUERIES | duplicates.QUERIES | markets.QUERIES | feeds.QUERIES | stores.QUERIES | imports.QUERIES | ladders.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.compare_cheapest_next_store(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
