"""Registries of methods and principal components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.columns import correlation, principal_loadings
from ledgerline.operators import methods, stats


@pytest.mark.parametrize("seed, k", [(0, 2), (1, 3), (2, 5)])
def test_loadings_are_those_of_the_first_component(spark, seed, k):
    x = np.random.default_rng(seed).normal(size=(40, k)) @ np.random.default_rng(seed + 9).normal(size=(k, k))
    cov = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    want = np.abs(vectors[:, -1]) / np.abs(vectors[:, -1]).sum()
    matrix = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in cov])
    assert np.allclose(spark.range(1).select(principal_loadings(matrix)).first()[0], want, atol=1e-9)
    rows = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>")
    assert np.allclose([r["weight"] for r in stats.principal_weights(rows, "v").orderBy("dim").collect()], want, atol=1e-6)


def test_loadings_of_nothing(spark):
    zero = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))
    assert spark.range(1).select(principal_loadings(zero)).first()[0] == [0.0, 0.0]


def test_correlation_uses_rows_with_both(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (9.0, None), (None, 4.0)], "a double, b double")
    assert df.agg(correlation(F.col("a"), F.col("b"))).first()[0] == pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1])
    assert df.agg(correlation(F.col("a"), F.lit(1.0))).first()[0] is None


def panel(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"s{i % 2}", f"u{i % 5}", float(rng.lognormal()), float(rng.lognormal()), None if i % 9 == 0 else float(rng.normal())) for i in range(90)]
    return spark.createDataFrame(rows, "key long, sector string, sub string, a double, b double, c double")


def test_a_registered_weighter_takes_part(spark, monkeypatch):
    assert set(methods.choices()["weighting"]) == {"equal", "entropy", "critic", "principal"}
    monkeypatch.setattr(methods, "WEIGHTERS", dict(methods.WEIGHTERS))

    @methods.weighter("first only")
    def first_only(p):
        return {m: p.only(m, F.lit(1.0 if m == p.metrics[0] else 0.0)) for m in p.metrics}

    draws = methods.sample_draws(spark, 200, 7, ["a", "b", "c"])
    chosen = {r["weighting"] for r in draws.where("kind = 'method'").select("weighting").distinct().collect()}
    assert chosen == set(methods.choices()["weighting"]) >= {"first only"}
    own = draws.where("weighting = 'first only' and kind = 'method' and (dropped is null or dropped <> 'a')").limit(3)
    got = methods.percentiles(panel(spark), ["a", "b", "c"], own, 7).where("pct is not null")
    assert got.count() == 90 * own.count()


def test_weights_sum_to_one_and_leave_out_what_is_dropped(spark):
    draws = methods.sample_draws(spark, 60, 11, ["a", "b", "c"])
    cells = panel(spark).select("key", *[(F.percent_rank().over(methods.Window.orderBy(m)) + 0.01).alias(m) for m in "abc"])
    cells = cells.crossJoin(F.broadcast(draws.select("run")))
    seen = set()
    for r in methods._weights(cells, draws, ["a", "b", "c"]).join(draws, "run").collect():
        weights = {m: r[f"w_{m}"] for m in "abc"}
        assert sum(weights.values()) == pytest.approx(1.0) and min(weights.values()) >= 0
        assert r["dropped"] is None or weights[r["dropped"]] == 0
        seen.add(r["weighting"])
    assert seen == set(methods.choices()["weighting"])
