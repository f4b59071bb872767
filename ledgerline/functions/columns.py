"""Column functions that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerline.functions.hashing import hash_pair


def safe_div(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0 or either is missing."""
    return F.try_divide(a, b)


def positive(x: Column) -> Column:
    """NULL unless x > 0: zero and negative amounts count as missing."""
    return F.when(x > 0, x)


def clip(x: Column, low: float, high: float) -> Column:
    """x between low and high; a missing x stays missing."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ramp(x: Column, a: float, b: float) -> Column:
    """0 at a, 1 at b (b may be below a), straight between, missing for a missing x."""
    return clip((x - F.lit(float(a))) / F.lit(float(b - a)), 0.0, 1.0)


def average_rank(x: Column, group: WindowSpec, group_columns: list[Column]) -> Column:
    """Rank of x in its group, equal values sharing their mean rank; missing for missing."""
    order = Window.partitionBy(*group_columns).orderBy(x.asc_nulls_last())
    same = Window.partitionBy(*group_columns, x)
    rank = F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0)
    return F.when(x.isNotNull(), rank)


def percentile_rank(x: Column, group_columns: list[Column]) -> Column:
    """Average-tie rank over the number of values of the group, 0 to 1."""
    group = Window.partitionBy(*group_columns)
    return average_rank(x, group, group_columns) / F.count(x).over(group)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation over the rows that have both; missing where a side is constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def principal_loadings(matrix: Column, squarings: int = 40) -> Column:
    """Absolute loadings of the first principal component of a covariance matrix (array of rows), scaled to the sum 1.

    Power iteration by repeated squaring: the largest eigenvalue outgrows all others, and every row points along its
    vector; the row with the largest diagonal is taken.  A matrix of noughts gives noughts."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def squared(m: Column) -> Column:
        # Symmetric: a cell of the product is that of two rows.
        product = F.transform(m, lambda a: F.transform(m, lambda b: dot(a, b)))
        largest = F.array_max(F.transform(F.flatten(product), lambda x: F.abs(x)))
        return F.transform(product, lambda row: F.transform(row, lambda x: F.coalesce(F.try_divide(x, largest), F.lit(0.0))))

    power = F.aggregate(F.sequence(F.lit(1), F.lit(squarings)), matrix, lambda m, _: squared(m))
    rows = F.transform(power, lambda row, k: F.struct(F.get(row, k).alias("diagonal"), row.alias("row")))
    load = F.transform(F.array_max(rows)["row"], lambda x: F.abs(x))
    total = F.aggregate(load, F.lit(0.0), lambda s, x: s + x)
    return F.transform(load, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


def hash_digits(*key: Column) -> Column:
    """The 13 hexadecimal digits that hash_uniform reads: they are in the same order as its numbers, and cheaper."""
    return F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 13)


def uniform_digits(u: float) -> str:
    """The least digits whose uniform number is u or more."""
    n = math.ceil(u * 4503599627370496.0 - 0.5)
    return "" if n <= 0 else "g" if n >= 1 << 52 else f"{n:013x}"  # before all digits, after all


def hash_uniform(*key: Column) -> Column:
    """A uniform number in (0, 1) that follows from the key alone: 52 bits of md5."""
    return (F.conv(hash_digits(*key), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4503599627370496.0)


def hash_normal(*key: Column) -> Column:
    """A standard normal number that follows from the key alone (Box-Muller), by the numbers of hash_uniform, hashed many at once."""
    pair = hash_pair(F.concat_ws("|", *[k.cast("string") for k in key]))
    u, v = ((pair[end] + F.lit(0.5)) / F.lit(4503599627370496.0) for end in "ab")
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


#: The rational approximation of the normal distribution function
#: (Abramowitz and Stegun 26.2.17).
PHI = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def phi(z: Column) -> Column:
    """The normal distribution function, to 7.5e-8."""
    p, *b = PHI
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = t * (F.lit(c) + poly)
    upper = F.lit(1.0 / math.sqrt(2.0 * math.pi)) * F.exp(-z * z / F.lit(2.0)) * poly
    return F.when(z >= 0, F.lit(1.0) - upper).otherwise(upper)


def weighted_mean(values: list[Column], weights: list[Column], geometric: bool = False, floor: float = 1e-6) -> Column:
    """Mean over the values that are there, weights scaled to them; missing if none is."""
    total, mass = F.lit(0.0), F.lit(0.0)
    for x, w in zip(values, weights, strict=True):
        term = F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(floor)))) if geometric else x
        total = total + F.coalesce(w * term, F.lit(0.0))
        mass = mass + F.when(x.isNotNull(), w).otherwise(0.0)
    mean = F.try_divide(total, mass)
    return F.exp(mean) if geometric else mean
