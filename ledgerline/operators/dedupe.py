"""Ordered choice of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of every key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key: order descending, as given."""
    return keep_first(df, keys, order)
