"""Registry of the analytics queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import facts, filings, panels, quality, reviews, scores  # noqa: F401  (they register their queries)
from .base import QUERIES, SQL, Tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.flagship(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
