"""Normalisers, weights, aggregation and simulated bands of scores within peers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import clip, hash_normal, phi
from ledgerline.operators.ranking import group_quantiles, percentile_ranks
from ledgerline.sources.shared import stored

EPS, TINY = 0.01, 1e-12
#: Groups with fewer values aren't winsorised.
WINSORISED = 5


#: Groups whose statistics are broadcast at most.
BROADCAST = 200_000


def joined(df: DataFrame, own: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """df with the other columns of own (stored, a row a group)."""
    key = [f"_{c}" for c in group]
    own = own.select(*[F.col(c).alias(k) for c, k in zip(group, key, strict=True)], *[c for c in own.columns if c not in group])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(group, key, strict=True)])
    return df.join(F.broadcast(own) if own.count() <= BROADCAST else own, same, how).drop(*key)


def _left(every: DataFrame, own: DataFrame, group: list[str]) -> DataFrame:
    """Every group with the other columns of own, missing where it has no row there."""
    key = [f"_{c}" for c in group]
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(group, key, strict=True)])
    return every.join(own.withColumnsRenamed(dict(zip(group, key, strict=True))), same, "left").drop(*key)


def _beside(df: DataFrame, group: list[str], **stats: Column) -> DataFrame:
    """df with statistics of its groups: one aggregation with partial sums, joined back, instead of windows over whole groups."""
    return joined(df, stored(df.groupBy(*group).agg(*[x.alias(name) for name, x in stats.items()]), "group-statistics"), group)


def _rescaled(x: Column, low: Column, high: Column) -> Column:
    """From EPS to 1; constant groups, and groups without values, 0.5 in every row."""
    return F.when(F.coalesce(high - low, F.lit(0.0)) < TINY, 0.5).otherwise(EPS + (1 - EPS) * (x - low) / (high - low))


def winsor_bounds(df: DataFrame, x: str, group: list[str], p: float = 0.05) -> DataFrame:
    """group, _q (the p and 1 - p quantiles) and _n (values): what winsor_z and min_max take."""
    found = group_quantiles(df, x, group, [p, 1 - p], "_q")
    return found.withColumnRenamed("_count", "_n")


def _winsorised(df: DataFrame, x: str, group: list[str], p: float, bounds: DataFrame | None = None) -> DataFrame:
    """df with _v: x between the p and 1 - p quantiles of groups of five values or more."""
    every = df.select(*group).distinct()  # groups without values too
    bounds = winsor_bounds(df, x, group, p) if bounds is None else bounds
    df = joined(df, stored(_left(every, bounds, group), "winsor-bounds"), group)
    inside = F.greatest(F.element_at("_q", 1), F.least(F.element_at("_q", 2), F.col(x)))
    df = df.withColumn("_v", F.when(F.col(x).isNotNull(), F.when((F.col("_n") >= WINSORISED) & F.lit(p > 0), inside).otherwise(F.col(x))))
    return df.drop("_q", "_n")


def rank_score(df: DataFrame, x: str, group: list[str], out: str, direction: int = 1) -> DataFrame:
    """Average-tie percentile rank of the oriented value, from EPS to 1."""
    ranked = percentile_ranks(df.withColumn("_oriented", direction * F.col(x)), {"_oriented": "_pct"}, group)
    return ranked.withColumn(out, EPS + (1 - EPS) * F.col("_pct")).drop("_oriented", "_pct")


def winsor_z(df: DataFrame, x: str, group: list[str], out: str, p: float = 0.05, direction: int = 1, bounds: DataFrame | None = None) -> DataFrame:
    """Winsorised and oriented z (population deviation), clipped at 3, rescaled in the group."""
    df = _beside(_winsorised(df, x, group, p, bounds), group, _m=F.avg("_v"), _s=F.stddev_pop("_v"), _a=F.min("_v"), _b=F.max("_v"))
    z = lambda v: clip(direction * F.when(F.col("_s") > TINY, (F.col(v) - F.col("_m")) / F.col("_s")).otherwise(F.col(v) * 0.0), -3.0, 3.0)
    low, high = ("_a", "_b") if direction > 0 else ("_b", "_a")
    return df.withColumn(out, _rescaled(z("_v"), z(low), z(high))).drop("_v", "_m", "_s", "_a", "_b")


def min_max(df: DataFrame, x: str, group: list[str], out: str, p: float = 0.05, direction: int = 1, bounds: DataFrame | None = None) -> DataFrame:
    """Winsorised and oriented value, rescaled between the group's own least and largest."""
    df = _beside(_winsorised(df, x, group, p, bounds), group, _a=F.min(direction * F.col("_v")), _b=F.max(direction * F.col("_v")))
    return df.withColumn(out, _rescaled(direction * F.col("_v"), F.col("_a"), F.col("_b"))).drop("_v", "_a", "_b")


def winsor_scores(df: DataFrame, x: str, group: list[str], z: str, scaled: str, p: float = 0.05) -> DataFrame:
    """winsor_z and min_max of the same x: bounds and statistics are found, and joined to the rows, once for both."""
    df = _beside(_winsorised(df, x, group, p), group, _m=F.avg("_v"), _s=F.stddev_pop("_v"), _a=F.min("_v"), _b=F.max("_v"))
    of = lambda v: clip(F.when(F.col("_s") > TINY, (F.col(v) - F.col("_m")) / F.col("_s")).otherwise(F.col(v) * 0.0), -3.0, 3.0)
    df = df.withColumn(z, _rescaled(of("_v"), of("_a"), of("_b"))).withColumn(scaled, _rescaled(F.col("_v"), F.col("_a"), F.col("_b")))
    return df.drop("_v", "_m", "_s", "_a", "_b")


def median_mad(df: DataFrame, x: str, group: list[str], out: str, direction: int = 1) -> DataFrame:
    """Oriented robust z by median and median deviation, clipped at 3, rescaled in the group."""
    df = _beside(df, group, _m=F.median(x), _a=F.min(x), _b=F.max(x))
    df = _beside(df.withColumn("_d", F.abs(F.col(x) - F.col("_m"))), group, _mad=F.median("_d"))
    z = lambda v: clip(direction * F.when(F.col("_mad") > TINY, (F.col(v) - F.col("_m")) / (1.4826 * F.col("_mad"))).otherwise(F.col(v) * 0.0), -3.0, 3.0)
    low, high = ("_a", "_b") if direction > 0 else ("_b", "_a")
    return df.withColumn(out, _rescaled(z(x), z(low), z(high))).drop("_m", "_a", "_b", "_d", "_mad")


def phi_z(df: DataFrame, x: str, group: list[str], out: str, p: float = 0.05) -> DataFrame:
    """The normal distribution function of the winsorised z score, between 0.01 and 1; constant groups 0.5."""
    df = _beside(_winsorised(df, x, group, p), group, _m=F.avg("_v"), _s=F.stddev_pop("_v"))
    z = F.when(F.col("_s") > 0, (F.col("_v") - F.col("_m")) / F.col("_s"))
    return df.withColumn(out, F.coalesce(clip(phi(z), EPS, 1.0), F.lit(0.5))).drop("_v", "_m", "_s")


NORMALISERS = {"rank": rank_score, "winsor-z": winsor_z, "min-max": min_max, "median-mad": median_mad}


def _shares(df: DataFrame, x: str) -> Column:
    """x over its sum; equal parts where the sum is (nearly) nothing or not a number.  df has a row a metric."""
    every = Window.partitionBy()
    bad = F.max((F.col(x).isNull() | F.isnan(x)).cast("int")).over(every) == 1
    total = F.sum(x).over(every)
    return F.when(bad | (total <= TINY), F.lit(1.0) / F.count(F.lit(1)).over(every)).otherwise(F.col(x) / total)


def entropy_weights(long: DataFrame) -> DataFrame:
    """metric, weight from (metric, score) with a row for every company, missing scores too: the more unequal a metric, the more it weighs."""
    sums = long.groupBy("metric").agg(F.sum("score").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    share = F.when(F.col("score") > 0, F.col("score") / F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(1.0))
    p = F.when(share > 0, share).otherwise(F.lit(TINY))
    cells = long.join(F.broadcast(sums), "metric").select("metric", "_rows", p.alias("p"))  # a row a metric
    e = cells.groupBy("metric").agg((1.0 + F.sum(F.col("p") * F.log("p")) / F.log(F.greatest(F.first("_rows"), F.lit(2)))).alias("d"))
    return e.select("metric", _shares(e, "d").alias("weight"))


def critic_weights(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, weight by deviation times disagreement: sd_i * sum_j (1 - r_ij) over the rows that have both;
    a correlation that isn't a number counts as 0, and a single metric weighs 1."""
    corr = lambda a, b: F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))
    own = lambda a: 1.0 - F.when(F.stddev_pop(a) > 0, 1.0).otherwise(0.0)
    cells = [(F.stddev_pop(a) * sum((1.0 - corr(a, b) for b in metrics if b != a), own(a))).alias(a) for a in metrics]
    row = wide.agg(*cells)
    long = row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*metrics))).alias("metric", "c"))
    return long.select("metric", _shares(long, "c").alias("weight"))


def noisy(df: DataFrame, x: Column, sd: Column, confidence: Column, *key: Column) -> Column:
    """x with noise that grows as confidence falls: sd * (0.05 + 0.35 * (1 - confidence)) * N(0, 1)."""
    doubt = F.lit(1.0) - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0))))
    return x + sd * (F.lit(0.05) + F.lit(0.35) * doubt) * hash_normal(*key)


def bands(draws: DataFrame, key: list[str], value: str) -> DataFrame:
    """p10, p50, p90, their width, the shares of draws in the top and bottom fifth, and runs (their number)."""
    q = F.percentile(value, F.array(*map(F.lit, (0.1, 0.5, 0.9))))
    # Values are dealt by key before they are counted: maps of single values would be larger than these.
    agg = draws.select(*key, value).repartition(*key).groupBy(*key).agg(
        q.alias("q"), F.avg((F.col(value) >= 80).cast("double")).alias("top_share"),
        F.avg((F.col(value) <= 20).cast("double")).alias("bottom_share"), F.count(F.lit(1)).alias("runs"),
    )
    at = lambda i: F.element_at("q", i)
    return agg.select(
        *key, at(1).alias("p10"), at(2).alias("p50"), at(3).alias("p90"), (at(3) - at(1)).alias("width"), "top_share", "bottom_share", "runs"
    )


def main_effects(draws: DataFrame, factors: list[str], value: str) -> DataFrame:
    """factor, first_order: the share of the variance of value between the levels of a factor.

    One pass: all factors are grouped by one GROUPING SETS aggregation."""
    which = F.lit("")
    for f in factors:
        which = F.when(F.grouping(f) == 0, f).otherwise(which)
    grouped = draws.groupingSets([*[[F.col(f)] for f in factors], []], *map(F.col, factors)).agg(
        which.alias("factor"), F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"), F.var_pop(value).alias("v")
    )
    total = grouped.where("factor = ''").select(F.col("m").alias("mean"), F.col("v").alias("total"), F.col("n").alias("all"))
    within = grouped.where("factor <> ''").crossJoin(F.broadcast(total))  # one row
    return within.groupBy("factor").agg(
        F.try_divide(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2) / F.first("all"), F.first("total")).alias("first_order")
    )


def _cell_sums(n_factors: int):
    """Rows (key, value, levels of the factors) sorted by key -> for batches of whole keys: sums over keys of what each factor alone
    and all others explain of the variance, and the variance."""
    sets = [s for k in range(n_factors) for s in ([k], [j for j in range(n_factors) if j != k])]

    def told(rows: pa.Table) -> pa.RecordBatch:
        code = lambda c: rows.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() + 1
        key = np.unique(code(0), return_inverse=True)[1]
        n = np.bincount(key)
        value = rows.column(1).to_numpy()
        y = value - (np.bincount(key, value) / n)[key]
        levels = [code(k + 2) for k in range(n_factors)]
        explained = []
        for s in sets:
            cell, size = key, 1
            for k in s:
                width = int(levels[k].max()) + 1
                cell, size = cell * width + levels[k], size * width
            count, total = np.bincount(cell, minlength=len(n) * size), np.bincount(cell, y, len(n) * size)
            held = np.flatnonzero(count)
            explained.append(float((total[held] ** 2 / count[held] / n[held // size]).sum()))
        return pa.RecordBatch.from_arrays([pa.array([explained], pa.list_(pa.float64())), pa.array([float((y * y / n[key]).sum())])], names=["explained", "whole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            key = held.column(0).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if len(key) and (key != key[-1]).any() else 0
            if whole:
                yield told(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield told(held)

    return run


def factorial_effects(draws: DataFrame, key: str, factors: list[str], value: str) -> DataFrame:
    """factor, first_order, total, share over a full factorial, each key about its own mean:
    Var(E[value | factor]) / Var and 1 - Var(E[value | all other factors]) / Var, variances summed over keys.

    A key's rows meet in one task, where its cells are summed; a few numbers a batch go on."""
    rows = draws.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double"), *factors)
    sums = rows.repartition(key).sortWithinPartitions(key).mapInArrow(_cell_sums(len(factors)), "explained array<double>, whole double")
    whole = sums.agg(F.sum("whole").alias("whole"), *[F.sum(F.get("explained", F.lit(k))).alias(f"_{k}") for k in range(2 * len(factors))])
    part = lambda k: F.try_divide(F.col(f"_{k}"), F.col("whole"))
    each = [F.struct(F.lit(f).alias("factor"), clip(part(2 * k), 0.0, 1.0).alias("first_order"), clip(1.0 - part(2 * k + 1), 0.0, 1.0).alias("total")) for k, f in enumerate(factors)]
    found = whole.where("whole is not null").select(F.inline(F.array(*each)))
    return found.withColumn("share", F.try_divide(F.col("first_order"), F.sum("first_order").over(Window.partitionBy())))  # one row a factor
