"""Ranks inside groups of any size: ranges of a large group's values give what one sort of it gives."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import ranking


@pytest.fixture(scope="module")
def rows():
    """One group with nine tenths of the rows, a value that a third of it shares, small groups, a null group, missing values."""
    rng = random.Random(4)
    out = []
    for i in range(3000):
        g = "big" if rng.random() < 0.9 else rng.choice(["a", "b", None, "c"])
        x = 7.0 if rng.random() < 0.33 else None if rng.random() < 0.05 else round(rng.lognormvariate(0, 3), rng.choice([1, 6]))
        out.append((i, g, x, -x if x is not None and i % 2 else 0.5))
    return out


def brute_ranks(rows, column):
    groups = defaultdict(list)
    for row in rows:
        if row[column] is not None:
            groups[row[1]].append(row[column])
    out = {}
    for row in rows:
        x, own = row[column], groups[row[1]]
        out[row[0]] = None if x is None else (sum(y < x for y in own) + (sum(y == x for y in own) + 1) / 2) / len(own)
    return out


@pytest.mark.parametrize("large, ranges", [(10**6, 4), (200, 16), (20, 5), (0, 3)])
def test_percentile_ranks(spark, rows, large, ranges):
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    got = ranking.percentile_ranks(df, {"x": "px", "y": "py"}, ["g"], large=large, ranges=ranges).collect()
    assert len(got) == len(rows)
    for column, name in ((2, "px"), (3, "py")):
        want = brute_ranks(rows, column)
        assert all(r[name] == want[r["id"]] if want[r["id"]] is None else abs(r[name] - want[r["id"]]) < 1e-12 for r in got)


@pytest.mark.parametrize("large", [10**6, 100])
@pytest.mark.parametrize("descending", [False, True])
def test_row_numbers(spark, rows, large, descending):
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    got = {r["id"]: r["k"] for r in ranking.group_row_numbers(df, "x", "id", ["g"], "k", descending, large=large, ranges=7).collect()}
    groups = defaultdict(list)
    for i, g, x, _ in rows:
        if x is not None:
            groups[g].append((-x if descending else x, i))
    assert got == {i: k for own in groups.values() for k, (_, i) in enumerate(sorted(own), 1)}


def test_no_task_ranks_a_large_group(spark, rows):
    """The rows that one window holds: a range has about its share of the group's different values, however skewed they are."""
    df = spark.createDataFrame([(i, g, x) for i, g, x, _ in rows], "id long, g string, x double")
    ranged = ranking.ranged_values(df.where("g = 'big'"), "x", ["g"], 32)
    sizes = Counter(r["_range"] for r in ranged.collect())
    assert len(sizes) == 32 and max(sizes.values()) <= 2 * sum(sizes.values()) / 32


def test_sizes_from_another_table(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    sized = df.where("false").select("g")  # says that no group is large
    assert ranking.large_groups(sized, ["g"], 5) is None
    assert {r["g"] for r in ranking.large_groups(df, ["g"], 1000).collect()} == {"big"}


def test_nothing(spark):
    none = spark.createDataFrame([], "id long, g string, x double")
    assert ranking.percentile_ranks(none, {"x": "p"}, ["g"]).collect() == []
    gone = spark.createDataFrame([(1, "a", None), (2, None, None)], "id long, g string, x double")
    assert [r["p"] for r in ranking.percentile_ranks(gone, {"x": "p"}, ["g"], large=0).collect()] == [None, None]


def test_queries_hold_when_every_group_is_large(spark, monkeypatch):
    import oracle

    from ledgerline.plans import catalogue

    sf = "/root/testdata/sf0.001"
    con = oracle.connect(sf)
    monkeypatch.setattr(ranking, "LARGE", 10)
    for name in ("q06_avg_pct_rank", "q17_score_once_fixed_draw", "q20_rank_bands", "q82_axis_weight_profiles"):
        assert oracle.differences(catalogue.queries()[name](spark, sf).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()) == "", name


@pytest.mark.parametrize("few", [2000, 50, 0])
def test_group_quantiles(spark, rows, monkeypatch, few):
    """By selection, whatever the size of a group and however its values repeat."""
    import numpy as np

    monkeypatch.setattr(ranking, "FEW", max(few, 3))
    monkeypatch.setattr(ranking, "NEAR", 0.05)
    df = spark.createDataFrame([r[:3] for r in rows], "id long, g string, x double")
    probabilities = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r["g"]: (r["q"], r["_count"]) for r in ranking.group_quantiles(df, "x", ["g"], probabilities, "q").collect()}
    groups = defaultdict(list)
    for _, g, x, _ in rows:
        if x is not None:
            groups[g].append(x)
    assert set(got) == set(groups)
    for g, own in groups.items():
        if len(own) > 200 or few >= 2000:
            assert np.allclose(got[g][0], np.quantile(own, probabilities), rtol=1e-12) and got[g][1] == len(own)


def test_a_frequent_value_is_a_cut(spark, rows):
    """Its rows need no order, so they are spread; ranges between cuts hold about their share."""
    df = spark.createDataFrame([r[:3] for r in rows], "id long, g string, x double").where("g = 'big' and x is not null")
    ranged = ranking._ranges_of(df, "x", ["g"], ranking.large_groups(df, ["g"], 10), 16).collect()
    assert all(r["_at"] and r["_range"] % 2 == 1 for r in ranged if r["x"] == 7.0)
    even = Counter(r["_range"] for r in ranged if not r["_at"])
    assert max(even.values()) <= 1.2 * len(ranged) / 16 + 5


def test_equal_orders_make_equal_sums(spark, tmp_path):
    """0.1 + 0.2 + 0.3 in any order: customers with the same orders tie."""
    import itertools

    from ledgerline.plans import scores

    for name in ("nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    orders = [(10 * k + i, k, p) for k, ps in enumerate(itertools.permutations([0.1, 0.2, 0.3, 1e6])) for i, p in enumerate(ps)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, 1, "A", 5.0) for k in range(24)], "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    found = scores.scored(scores.Tables(spark, str(tmp_path))).collect()
    assert len(found) == 24 and {r["spend"] for r in found} == {12.5 / 24}
