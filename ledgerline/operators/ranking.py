"""Ranks over a whole table or inside groups of any size, without sending a table or a large group through one task.

Values are dealt to ranges between approximate quantiles; ranks run inside a range and are moved on by the
sizes of the ranges before.

Inside groups, that is done for the groups of more than LARGE rows only, which are found by one count.  Their rows are
stored, so that cuts, offsets and ranks are of the same rows.  Values that are cuts themselves get their rank from counts alone
and are spread over tasks; between cuts, ranges are ranked by windows, as small groups are."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.shared import stored

RANGES = 64
#: Rows of a group that one task ranks at most; ranges of a larger one.
LARGE, GROUP_RANGES = 500_000, 64


def _ranged(df: DataFrame, x: str) -> DataFrame:
    cuts = df.agg(F.percentile_approx(x, F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(10_000)).alias("_cuts"))
    place = F.size(F.filter("_cuts", lambda c: c < F.col(x)))
    return df.crossJoin(F.broadcast(cuts)).withColumn("_range", place).drop("_cuts")  # one row


def _moved(df: DataFrame, n: Column, descending: bool = False) -> DataFrame:
    """_range and how much n is in the ranges before it."""
    totals = df.groupBy("_range").agg(F.sum(n).alias("_own"))
    order = Window.orderBy(F.desc("_range") if descending else F.col("_range"))
    return totals.select("_range", (F.sum("_own").over(order) - F.col("_own")).alias("_before"))


def row_numbers(df: DataFrame, x: str, tie: str, out: str, descending: bool = False) -> DataFrame:
    """df (its rows where x isn't missing) with their place in the order of x, then tie, from 1."""
    ranged = _ranged(df.where(F.col(x).isNotNull()), x)
    w = Window.partitionBy("_range").orderBy(F.desc(x) if descending else F.col(x), tie)
    moved = _moved(ranged, F.lit(1), descending)
    return ranged.withColumn(out, F.row_number().over(w)).join(F.broadcast(moved), "_range").withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before")


def value_ranks(df: DataFrame, x: str) -> DataFrame:
    """x, n (rows with this value) and rank (their mean rank): one row a value."""
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("n"))
    ranged = _ranged(counts, x)
    w = Window.partitionBy("_range").orderBy(x)
    local = F.sum("n").over(w) - F.col("n")
    ranked = ranged.withColumn("_local", local).join(F.broadcast(_moved(ranged, F.col("n"))), "_range")
    return ranked.select(x, "n", (F.col("_local") + F.col("_before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with every column replaced by its average-tie rank; missing stays missing."""
    given = df  # ranks follow from the table as given, not from what was joined to it
    for c in columns:
        ranks = value_ranks(given, c).select(F.col(c).alias("_value"), F.col("rank").alias("_rank"))
        df = df.join(ranks, F.col(c) == F.col("_value"), "left").withColumn(c, F.col("_rank")).drop("_value", "_rank")
    return df


def _same(group: list[str], keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(group, keys, strict=True)], F.lit(True))


def _keyed(df: DataFrame, group: list[str], *kept: str) -> tuple[DataFrame, list[str]]:
    """df with its group columns under names that clash with none, and these names."""
    keys = [f"_key_{c}" for c in group]
    return df.select(*[F.col(c).alias(k) for c, k in zip(group, keys, strict=True)], *kept), keys


def large_groups(df: DataFrame, group: list[str], large: int) -> DataFrame | None:
    """The groups of more than so many rows, stored; None if there is none."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > large)
    return stored(counts.drop("_rows"), "large-groups") if not counts.isEmpty() else None


def ranged_values(df: DataFrame, x: str, group: list[str], ranges: int = GROUP_RANGES) -> DataFrame:
    """group, x, _n (rows), _range: the different values of every group, in ranges of about as many values."""
    values = df.where(F.col(x).isNotNull()).groupBy(*group, x).agg(F.count(F.lit(1)).alias("_n"))
    cuts = values.groupBy(*group).agg(F.percentile_approx(x, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(10_000)).alias("_cuts"))
    cuts, keys = _keyed(stored(cuts, "rank-cuts"), group, "_cuts")
    # One row for each large group: at most rows / LARGE.
    placed = values.join(F.broadcast(cuts), _same(group, keys))
    return placed.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(x)))).drop("_cuts", *keys)


def _ranges_of(df: DataFrame, x: str, group: list[str], found: DataFrame, ranges: int) -> DataFrame:
    """df with _range and _at (whether x is a cut of a large group).

    Cuts are approximate quantiles of a large group's rows: from one to the next is an even range, a cut itself an odd one.  A value
    that more rows share than a range has is always a cut, so no even range is much larger than others, however rows repeat.
    Small groups are range 0, missing values -1."""
    same = lambda keys: _same(group, keys)
    of, keys = _keyed(found, group)
    cuts = df.where(F.col(x).isNotNull()).join(F.broadcast(of), same(keys), "left_semi").groupBy(*group)
    cuts = cuts.agg(F.percentile_approx(x, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(1000)).alias("_cuts"))
    # One row for each large group: at most rows / LARGE.
    cuts, keys = _keyed(stored(cuts, "rank-cuts"), group, "_cuts")
    placed = df.join(F.broadcast(cuts), same(keys), "left").drop(*keys)
    # How many cuts are below x, in two steps: whole steps of cuts, then inside one.
    step = math.isqrt(ranges - 1) + 1
    above = lambda at: F.coalesce((F.col(x) > F.get("_cuts", at)).cast("int"), F.lit(0))
    placed = placed.withColumn("_steps", reduce(lambda a, b: a + b, [above(F.lit(i - 1)) for i in range(step, ranges, step)], F.lit(0)))
    inside = reduce(lambda a, b: a + b, [above(F.col("_steps") * step + k) for k in range(step)], F.lit(0))
    placed = placed.withColumn("_below", F.col("_steps") * step + inside)
    placed = placed.withColumn("_at", F.coalesce(F.col(x) == F.get("_cuts", F.col("_below")), F.lit(False)))
    number = F.when(F.col(x).isNull(), -1).when(F.col("_cuts").isNull(), 0).otherwise(2 * F.col("_below") + F.col("_at").cast("int"))
    return placed.withColumn("_range", number).drop("_cuts", "_steps", "_below")


def _offsets_of(ranged: DataFrame, group: list[str], found: DataFrame, descending: bool = False) -> tuple[DataFrame, list[str]]:
    """The ranges of large groups, stored: _own, _before and _size (rows of the range, of those before and of all), under names of their own."""
    of, keys = _keyed(found, group)
    own = ranged.where("_range >= 0").select(*group, "_range", "_at").join(F.broadcast(of), _same(group, keys), "left_semi")
    own = own.groupBy(*group, "_range", "_at").agg(F.count(F.lit(1)).alias("_own"))
    whole = Window.partitionBy(*group)  # as many rows as ranges
    before = F.sum("_own").over(whole.orderBy(F.desc("_range") if descending else F.col("_range"))) - F.col("_own")
    own = stored(own.select("*", before.alias("_before"), F.sum("_own").over(whole).alias("_size")), "rank-offsets")
    return _keyed(own.withColumnRenamed("_range", "_of").withColumnRenamed("_at", "_cut"), group, "_of", "_cut", "_own", "_before", "_size")


def _attached(df: DataFrame, x: str, group: list[str], given: DataFrame | None, found: DataFrame | None, ranges: int, out: str) -> DataFrame:
    """df with the percentile rank of x: one shuffle and one sort, by ranges where groups are large."""
    columns = df.columns
    if found is None:
        ranged = df.withColumn("_range", F.when(F.col(x).isNull(), -1).otherwise(0)).withColumn("_salt", F.lit(0))
    else:
        # Rows at a cut, and rows without a value, need no order: they are spread.
        spread = F.when(F.col("_at") | (F.col("_range") < 0), F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(ranges))).otherwise(0)
        ranged = _ranges_of(df, x, group, found, ranges).withColumn("_salt", spread)
    part = [*group, "_range", "_salt"]
    # One window over the sorted rows: frames differ, partitions and order don't.
    w, start = Window.partitionBy(*part).orderBy(x), Window.unboundedPreceding
    upto, every = (F.count(F.lit(1)).over(frame) for frame in (w.rangeBetween(start, Window.currentRow), w.rowsBetween(start, Window.unboundedFollowing)))
    ranged = ranged.select("*", F.rank().over(w).alias("_up"), upto.alias("_upto"), every.alias("_in"))
    local = (F.col("_up") + F.col("_upto")) / F.lit(2.0)
    if found is None:
        return ranged.select(*columns, F.when(F.col("_range") == 0, local / F.col("_in")).alias(out))
    own, keys = _offsets_of(_ranges_of(given, x, group, found, ranges), group, found)
    ranged = ranged.join(F.broadcast(own), _same(group, keys) & (F.col("_range") == F.col("_of")), "left")
    moved = F.col("_before") + F.when(F.col("_at"), (F.col("_own") + 1) / F.lit(2.0)).otherwise(local)
    rank = F.when(F.col("_size").isNull(), local / F.col("_in")).otherwise(moved / F.col("_size"))
    return ranged.select(*columns, F.when(F.col("_range") >= 0, rank).alias(out))


def percentile_ranks(
    df: DataFrame, columns: dict[str, str], group: list[str], sized_by: DataFrame | None = None, large: int | None = None, ranges: int = GROUP_RANGES
) -> DataFrame:
    """df with the average-tie rank over the number of values, 0 to 1, of columns (x: name of its rank) inside groups.

    sized_by: a table with at least as many rows in every group that is cheaper to count."""
    found = large_groups(sized_by if sized_by is not None else df, group, LARGE if large is None else large)
    given = df = df if found is None else stored(df, "rank-rows")  # scanned for cuts, for offsets and for the rows
    for x, name in columns.items():
        df = _attached(df, x, group, given, found, ranges, name)
    return df


def group_row_numbers(
    df: DataFrame, x: str, tie: str, group: list[str], out: str, descending: bool = False, sized_by: DataFrame | None = None,
    large: int | None = None, ranges: int = GROUP_RANGES,
) -> DataFrame:
    """df (its rows where x isn't missing) with their place in their group's order of x, then tie (different in equal x), from 1."""
    large = LARGE if large is None else large
    df = df.where(F.col(x).isNotNull())
    columns = df.columns
    order = F.desc(x) if descending else F.col(x)
    found = large_groups(sized_by if sized_by is not None else df, group, large)
    if found is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(order, tie)))
    df = stored(df, "rank-rows")
    ranged = _ranges_of(df, x, group, found, ranges)
    own, keys = _offsets_of(ranged, group, found, descending)
    same = _same(group, keys) & (F.col("_range") == F.col("_of"))
    hot = own.where(F.col("_cut") & (F.col("_own") > large))
    many = tie != x and not hot.isEmpty()
    rest = ranged.join(F.broadcast(hot), same, "left_anti") if many else ranged
    place = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(order, tie))
    before = F.coalesce("_before", F.lit(0))
    numbered = rest.withColumn("_place", place).join(F.broadcast(own), same, "left").select(*columns, (before + F.col("_place")).cast("int").alias(out))
    if not many:
        return numbered
    # Values that many rows of a group share: these are ordered by tie, by ranges of it.
    start = f"_before_{out}"
    common = ranged.join(F.broadcast(hot), same).select(*columns, F.col("_before").alias(start))
    common = group_row_numbers(common, tie, tie, [*group, x], f"_place_{out}", large=large, ranges=ranges)
    return numbered.unionByName(common.select(*columns, (F.col(start) + F.col(f"_place_{out}")).cast("int").alias(out)))


#: Groups of at most so many rows are ordered whole; how far from a quantile larger ones are searched, as a share of their rows.
FEW, NEAR = 2000, 0.004


def group_quantiles(df: DataFrame, x: str, group: list[str], probabilities: list[float], out: str) -> DataFrame:
    """group, out (exact interpolated quantiles of x, an array) and _count (values), a row a group, by selection: approximate quantiles (off
    by a thousandth of the rows at most) bound the values that may decide, rows below are counted, and only the values between are
    ordered.  df is scanned three times."""
    there = df.where(F.col(x).isNotNull()).select(*group, x)
    ends = F.array(*[F.lit(float(min(1, max(0, p + d)))) for p in probabilities for d in (-NEAR, NEAR)])
    cuts = there.groupBy(*group).agg(F.percentile_approx(x, ends, F.lit(1000)).alias("_ends"), F.count(F.lit(1)).alias("_total"))
    cuts, keys = _keyed(stored(cuts, "quantile-ends"), group, "_ends", "_total")
    beside = there.join(F.broadcast(cuts), _same(group, keys))  # a row a group
    few = F.col("_total") <= FEW
    low, high = lambda i: F.get("_ends", F.lit(2 * i)), lambda i: F.get("_ends", F.lit(2 * i + 1))
    below = beside.where(~few).groupBy(*group).agg(F.array(*[F.count_if(F.col(x) < low(i)) for i in range(len(probabilities))]).alias("_below"))
    below, other = _keyed(stored(below, "quantile-below"), group, "_below")
    other = [*other]
    near = [F.when(few | F.col(x).between(low(i), high(i)), F.lit(i)) for i in range(len(probabilities))]
    values = beside.withColumn("_i", F.explode(F.array_compact(F.array(*near)))).groupBy(*group, "_i", x).agg(F.count(F.lit(1)).alias("_n"), F.first("_total").alias("_total"))
    values = values.join(F.broadcast(below), _same(group, other), "left").drop(*other)
    upto = F.sum("_n").over(Window.partitionBy(*group, "_i").orderBy(x)) + F.coalesce(F.get("_below", F.col("_i")), F.lit(0))
    place = F.get(F.array(*map(F.lit, map(float, probabilities))), F.col("_i")) * (F.col("_total") - 1)
    values = values.withColumn("_upto", upto).withColumn("_place", place)
    held = lambda k: F.max(F.when((F.col("_upto") - F.col("_n") <= k) & (k < F.col("_upto")), F.col(x)))
    found = values.groupBy(*group, "_i").agg(
        held(F.floor("_place")).alias("_a"), held(F.ceil("_place")).alias("_b"), F.first("_place").alias("_place"), F.first("_total").alias("_total")
    )
    part = F.col("_place") - F.floor("_place")
    q = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("double")).otherwise((1 - part) * F.col("_a") + part * F.col("_b"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", q.alias("_q")))), lambda s: s["_q"])  # an element a probability
    return stored(found.groupBy(*group).agg(listed.alias(out), F.first("_total").alias("_count")), "quantiles")


def cuts_of(df: DataFrame, x: str, ranges: int = RANGES) -> list[float]:
    """Bounds of ranges of about as many rows each: so many numbers reach the driver."""
    found = df.agg(F.percentile_approx(x, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(10_000)).alias("c")).first()["c"]
    return sorted({float(c) for c in found or []})


def range_of(x: str, cuts: list[float]) -> Column:
    """How many cuts are below x, by a binary search written out."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(x) <= cuts[mid], among(low, mid)).otherwise(among(mid + 1, high))

    return among(0, len(cuts))


def offsets(df: DataFrame, group: list[str], n: Column) -> DataFrame:
    """group, _range, _before, _total: how much n is in a group's ranges before one, and in all; a group has as many rows as ranges."""
    own = df.groupBy(*group, "_range").agg(F.sum(n).alias("_own"))
    whole = Window.partitionBy(*group)
    return own.select(*group, "_range", (F.sum("_own").over(whole.orderBy("_range")) - F.col("_own")).alias("_before"), "_own", F.sum("_own").over(whole).alias("_total"))


def group_medians(df: DataFrame, x: str, group: list[str], out: str, cuts: list[float] | None = None) -> DataFrame:
    """group and the exact median of x, by selection: counts of ranges tell which hold the middle values, and only these are ordered.

    For few groups of any size (their offsets, one row a range, are broadcast)."""
    df = df.where(F.col(x).isNotNull())
    df = df.withColumn("_range", range_of(x, cuts_of(df, x) if cuts is None else cuts))
    low, high = F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2)
    holds = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_own"))
    middle = stored(offsets(df, group, F.lit(1)).where(holds(low) | holds(high)), "median-ranges")
    rows = df.join(F.broadcast(middle), [*group, "_range"])
    at = F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_range").orderBy(x)) - 1
    return rows.withColumn("_at", at).where((F.col("_at") == low) | (F.col("_at") == high)).groupBy(*group).agg(F.avg(x).alias(out))
