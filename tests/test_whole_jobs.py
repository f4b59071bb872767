"""Queries that must give every row of their job, not a part of it."""

import itertools
import random

import numpy as np
import pandas as pd
import projections
import pytest

from ledgerline.operators import methods, scoring, similar, stats
from ledgerline.plans import catalogue

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalogue.queries()[name](spark, SF)


def test_draw_matrix_has_all_keys_and_draws(spark):
    keys = spark.read.parquet(f"{SF}/customer.parquet").where("c_acctbal > 0").select("c_custkey")
    found = run(spark, "q94_draw_matrix_whole")
    assert keys.where("c_custkey > 50").count() > 0
    assert found.count() == found.select("key", "draw").distinct().count() == 40 * keys.count()


def test_best_matches_meet_in_any_order_of_tokens(spark):
    rng = random.Random(5)
    words = "steel north ring large iron a bb valley works of de la süd works".split()
    choices = sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)})
    names = sorted({" ".join(rng.sample(c.split(), len(c.split()))) for c in choices} | {"large ringe", "ab", "  north   stel", "valey", "\xa0ring\x1flarge", "zzz", ""})
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs] + [(None,)], "name string")
    for cutoff in (0.0, 40.0, 70.0, 92.0, 100.0):
        want = {}
        for n in names:
            score, choice = min((-similar.token_sort_ratio(n, c), c) for c in choices)
            if -score >= cutoff:
                want[n] = (choice, -score)
        got = {n: (m, s) for n, m, s in similar.best_matches(frame(names), frame(choices), cutoff).select("name", "match", "score").collect()}
        assert got == want


def test_fuzzy_query_finds_every_reversed_name(spark):
    names = spark.read.parquet(f"{SF}/part.parquet").select("p_name").distinct()
    found = run(spark, "q51_fuzzy_token_sort").where("score = 100")
    assert found.count() == names.count()


@pytest.mark.parametrize("cap", [0.06, 0.03])
def test_portfolio_of_a_table_is_that_of_the_projections(spark, cap):
    rng = np.random.default_rng(3)
    base, carbon, group = rng.dirichlet(np.ones(60) * 5), rng.gamma(0.5, 1, 60), rng.integers(0, 4, 60)
    want = projections.low_carbon_weights(base, carbon, group, np.zeros(60), cap)
    rows = [(i, float(b), float(c), int(g)) for i, (b, c, g) in enumerate(zip(base, carbon, group))]
    df = stats.low_carbon_portfolio(spark.createDataFrame(rows, "id int, benchmark double, carbon double, group int"), cap)
    got = np.array([w for _, w in sorted((x["id"], x["weight"]) for x in df.collect())])
    assert np.abs(got - want).max() < 1e-6
    assert got @ carbon <= 0.5 * (base @ carbon) + 1e-9
    assert all(got[group == g].sum() == pytest.approx(base[group == g].sum(), abs=1e-9) for g in range(4))


def test_portfolio_without_a_solution_fails(spark):
    df = spark.createDataFrame([(0.5, 1.0, 0), (0.5, 1.0, 0)], "benchmark double, carbon double, group int")
    with pytest.raises(ValueError):
        stats.low_carbon_portfolio(df, 1.0)


def test_portfolio_query_weighs_every_supplier(spark):
    sf = "/root/testdata/sf0.1"
    found = catalogue.queries()["q62_portfolio_qp"](spark, sf).toPandas()
    assert len(found) == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey").distinct().count() > 500
    assert found["weight"].sum() == pytest.approx(1, abs=1e-8) and found["benchmark"].sum() == pytest.approx(1, abs=1e-8)


def test_factorial_effects_are_those_of_the_definition(spark):
    rng = np.random.default_rng(4)
    shape = (2, 3, 4)
    cube = rng.normal(size=(*shape, 5)) + 3 * np.arange(2)[:, None, None, None] + np.arange(3)[None, :, None, None] * np.arange(4)[None, None, :, None]
    rows = [(k, a, b, c, float(cube[a, b, c, k])) for a, b, c, k in itertools.product(*map(range, (*shape, 5)))]
    df = spark.createDataFrame(rows, "key int, a int, b int, c int, y double")
    whole = cube.var(axis=(0, 1, 2)).sum()
    got = {x["factor"]: x for x in scoring.factorial_effects(df, "key", ["a", "b", "c"], "y").collect()}
    first = {f: cube.mean(axis=tuple(j for j in range(3) if j != i)).var(axis=0).sum() / whole for i, f in enumerate("abc")}
    total = {f: 1 - cube.mean(axis=i).var(axis=(0, 1)).sum() / whole for i, f in enumerate("abc")}
    for f in "abc":
        assert got[f]["first_order"] == pytest.approx(first[f]) and got[f]["total"] == pytest.approx(total[f])
        assert got[f]["share"] == pytest.approx(first[f] / sum(first.values()))


def by_hand(wide, metrics, d):
    """Percentiles of one draw without noise, after the definitions."""
    used = [m for m in metrics if m != d["dropped"]]
    own = wide["sub"].map(wide["sub"].value_counts())
    peer = "s:" + wide["sector"] if d["peers"] == "sector" else ("u:" + wide["sub"]).where(own >= 6, "s:" + wide["sector"])

    def rescale(s):
        return pd.Series(0.5, s.index) if not np.isfinite(s.max()) or s.max() - s.min() < 1e-12 else 0.01 + 0.99 * (s - s.min()) / (s.max() - s.min())

    def norm(s):
        p = d["winsor"]
        v = s.clip(s.quantile(p), s.quantile(1 - p)) if p > 0 and s.count() >= 5 else s
        if d["normaliser"] == "rank":
            return 0.01 + 0.99 * s.rank(pct=True)
        if d["normaliser"] == "min-max":
            return rescale(v)
        if d["normaliser"] == "winsor-z":
            return rescale(((v - v.mean()) / v.std(ddof=0)).clip(-3, 3) if v.std(ddof=0) > 1e-12 else v * 0)
        mad = (s - s.median()).abs().median()
        return rescale(((s - s.median()) / (1.4826 * mad)).clip(-3, 3) if mad > 1e-12 else s * 0)

    x = pd.DataFrame({m: wide[m].groupby(peer, group_keys=False).apply(norm).reindex(wide.index) for m in used})
    full = x.fillna(x.mean())
    if d["weighting"] == "entropy":
        p = full / full.sum()
        w = 1 + (p * np.log(p)).sum() / np.log(len(full))
    elif d["weighting"] == "critic":
        w = full.std(ddof=0) * (1 - full.corr().fillna(0)).sum()
    elif d["weighting"] == "principal":
        w = pd.Series(np.abs(np.linalg.eigh(np.atleast_2d(np.cov(full[used].T, bias=True)))[1][:, -1]), used)
    else:
        w = pd.Series(1.0, used)
    w = w / w.sum()
    mass = (x.notna() * w).sum(axis=1).replace(0, np.nan)
    score = np.exp((np.log(x) * w).sum(axis=1) / mass) if d["aggregation"] == "geometric" else (x * w).sum(axis=1) / mass
    return score.round(9).groupby(peer).rank(pct=True) * 100


def test_drawn_methods_are_those_of_the_definitions(spark):
    rng = np.random.default_rng(6)
    n, metrics = 90, ["a", "b", "c"]
    wide = pd.DataFrame({"key": range(n), "sector": [f"S{i % 3}" for i in range(n)], "sub": [f"U{i % 3}{0 if i % 7 else 1}" for i in range(n)]})
    for m in metrics:
        wide[m] = np.where(rng.random(n) < 0.15, np.nan, rng.gamma(2, 3, n).round(2))
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in row) for row in wide.itertuples(index=False, name=None)]
    df = spark.createDataFrame(rows, "key int, sector string, sub string, a double, b double, c double")
    drawn = methods.sample_draws(spark, 30, 5, metrics)
    found = methods.percentiles(df, metrics, drawn, 5).toPandas()
    sampled = [d for d in drawn.collect() if d["kind"] == "method"]
    for name, levels in methods.choices().items():
        assert {d[name] for d in sampled} == set(levels)
    assert {d["dropped"] for d in sampled} == {None, *metrics}
    for d in sampled:
        got = found[(found["kind"] == "method") & (found["draw"] == d["draw"])].set_index("key")["pct"].reindex(range(n))
        assert np.allclose(got, by_hand(wide, metrics, d), equal_nan=True, atol=1e-6), d
    assert found[found["kind"] == "noise"].groupby("key")["pct"].nunique().max() > 1
    assert set(found["kind"]) == {"combined", "method", "noise"}
