"""From facility quantities to company panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import positive, safe_div


def attribute(facts: DataFrame, owner: str, year: Column, quantity: Column, share: Column, facility: str) -> DataFrame:
    """owner, year, attributed (sum of quantity times share), n_facilities, confidence (mean share)."""
    rows = facts.select(F.col(owner), year.cast("bigint").alias("year"), quantity.alias("q"), share.alias("s"), F.col(facility).alias("f"))
    return rows.groupBy(owner, "year").agg(
        F.sum(F.col("q") * F.col("s")).alias("attributed"), F.countDistinct("f").alias("n_facilities"), F.avg("s").alias("confidence")
    )


def intensity(panel: DataFrame, revenue: DataFrame, keys: list[str]) -> DataFrame:
    """Joins revenue and divides by it; no revenue, no intensity."""
    return panel.join(revenue, keys, "left").withColumn("intensity", safe_div(F.col("attributed"), positive(F.col("revenue_musd"))))


def trend(panel: DataFrame, key: str, year: str, value: str, least: int = 3) -> DataFrame:
    """Log-linear growth over the positive years, and whether the first year can carry it."""
    v = positive(F.col(value))
    agg = panel.where(v.isNotNull()).groupBy(key).agg(
        F.expr(f"regr_slope(ln({value}), {year})").alias("slope"), F.count(F.lit(1)).alias("n_years"),
        F.min_by(value, year).alias("base"), F.median(value).alias("mid"),
    )
    growth = F.when(F.col("n_years") >= least, F.exp("slope") - 1)
    ratio = safe_div(F.col("base"), F.col("mid"))
    return agg.select(
        key, growth.alias("growth"), "n_years", ratio.alias("base_ratio"),
        ((F.col("n_years") >= least) & ratio.between(0.2, 2.5) & (F.abs(growth) <= 1)).alias("eligible"),
    )


def ols(panel: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """Slope of ln(value), its standard error and the residual deviation."""
    log = f"ln({value})"
    agg = panel.where(F.col(value) > 0).groupBy(key).agg(
        F.expr(f"regr_slope({log}, {year})").alias("slope"), F.count(F.lit(1)).alias("n"),
        F.expr(f"regr_sxx({log}, {year})").alias("sxx"), F.expr(f"regr_syy({log}, {year})").alias("syy"),
        F.expr(f"regr_sxy({log}, {year})").alias("sxy"),
    )
    residual = F.greatest(F.lit(0.0), F.col("syy") - safe_div(F.col("sxy") * F.col("sxy"), F.col("sxx")))
    deviation = F.when(F.col("n") > 2, F.sqrt(residual / (F.col("n") - 2)))
    return agg.select(key, "slope", "n", deviation.alias("resid_sd"), safe_div(deviation, F.sqrt("sxx")).alias("slope_se"))


def previous(panel: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """The value of the year before that is there, and the largest drop so far."""
    w = Window.partitionBy(key).orderBy(year)
    drop = F.col("prev") - F.col(value)
    return panel.withColumn("prev", F.lag(value).over(w)).withColumn(
        "worst_drop", F.max(drop).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
