"""Operators against small cases worked by hand."""

import json

import numpy as np
import projections
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import columns
from ledgerline.operators import identity, panel, scoring, similar, stats
from ledgerline.sources import tables
from ledgerline.streaming import events


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_percentile_rank_shares_ties_and_keeps_missing(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 4.0, 9.0, 9.0, 20.0)] + [("a", None)], "g string, x double")
    got = {x: p for x, p in values(df.withColumn("p", columns.percentile_rank(F.col("x"), [F.col("g")])), "x", "p")}
    assert got[None] is None
    assert [round(got[x], 6) for x in (1.0, 9.0, 20.0)] == [0.166667, 0.75, 1.0]


def test_ramp_and_clip_keep_missing(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.3,), (None,)], "x double")
    assert values(df.select(F.round(columns.ramp(F.col("x"), 0.5, 0.1), 6).alias("r")), "r") == [(1.0,), (0.0,), (0.5,), (None,)]


def test_weighted_mean_uses_what_is_there(spark):
    df = spark.createDataFrame([(1.0, 0.01), (None, 0.4), (None, None)], "a double, b double")
    half = [F.lit(0.5), F.lit(0.5)]
    both = [F.col("a"), F.col("b")]
    rows = values(df.select(F.round(columns.weighted_mean(both, half, geometric=True), 6).alias("g"), F.round(columns.weighted_mean(both, half), 6).alias("m")), "g", "m")
    assert rows == [(0.1, 0.505), (0.4, 0.4), (None, None)]


def test_trend_needs_three_years(spark):
    rows = [("a", y, 100 * 1.1 ** (y - 2018)) for y in range(2018, 2022)] + [("b", 2018, 1.0), ("b", 2019, 2.0)]
    got = {k: g for k, g in values(panel.trend(spark.createDataFrame(rows, "k string, year int, v double"), "k", "year", "v"), "k", "growth")}
    assert got["a"] == pytest.approx(0.1) and got["b"] is None


def test_constant_groups_score_half(spark):
    df = spark.createDataFrame([("a", 2.0)] * 3, "g string, x double")
    for f in (scoring.winsor_z, scoring.min_max, scoring.median_mad, scoring.phi_z):
        assert {x for (x,) in values(f(df, "x", ["g"], "s"), "s")} == {0.5}


def test_hash_noise_is_standard_normal_and_repeats(spark):
    df = spark.range(4000).select(columns.hash_normal(F.lit(1), F.col("id")).alias("z"))
    mean, sd = df.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(mean) < 0.06 and abs(sd - 1) < 0.05


def test_owner_lists(spark):
    texts = ["Alpha (60%); Beta", "A (80%); B (80%)", "Solo", "", None, "Alpha (US) (60%); Beta Corp.", "(50%); Gamma", " ; , .;(25%)", "A (50.5 %); B; C.,"]
    df = spark.createDataFrame([(x,) for x in texts], "raw string")
    got = [[(o["name"], round(o["share"], 6)) for o in x] for (x,) in values(df.select(identity.parse_owners(F.col("raw")).alias("o")), "o")]
    assert got == [[("Alpha", 0.6), ("Beta", 0.4)], [("A", 0.5), ("B", 0.5)], [("Solo", 1.0)], [], [],
                   [("Alpha (US)", 0.6), ("Beta Corp", 0.4)], [("Gamma", 1.0)], [], [("A", 0.505), ("B", 0.2475), ("C", 0.2475)]]


def test_token_sort_ratio():
    assert similar.token_sort_ratio("steel north", "north steel") == 100.0
    assert similar.token_sort_ratio("abc", "xyz") == 0.0


def test_portfolio_keeps_its_constraints():
    rng = np.random.default_rng(3)
    n = 60
    base = rng.dirichlet(np.ones(n) * 5)
    carbon, group = rng.gamma(0.5, 10, n), rng.integers(0, 4, n)
    w = projections.low_carbon_weights(base, carbon, group, rng.normal(size=n) * 0.001, 0.06, strength=1.0)
    assert w.sum() == pytest.approx(1, abs=1e-6) and w.min() >= -1e-9 and w.max() <= 0.06 + 1e-9
    assert w @ carbon <= 0.5 * (base @ carbon) + 1e-6
    for g in range(4):
        assert w[group == g].sum() == pytest.approx(base[group == g].sum(), abs=1e-6)


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Symbol,Security,GICS Sector,GICS Sub-Industry,CIK\nBRK.B, Berk ,Fin,Ins,10\nX,Y,Z,W,none\n")
    cached = str(tmp_path / "cache")
    for _ in range(2):
        got = tables.fetch(spark, "issuers", str(tmp_path / "c.csv"), cache=cached)
        assert [tuple(r) for r in got.collect()] == [("BRK-B", "Berk", "Fin", "Ins", 10)]
    fact = {"start": "2023-01-01", "end": "2023-12-31", "val": 5.0, "filed": "2024-02-01", "form": "10-K", "accn": "1"}
    (tmp_path / "f.json").write_text(json.dumps({"cik": 1, "facts": {"us-gaap": {"Assets": {"units": {"USD": [fact, fact | {"val": 6.0}]}}}}}) + "\n")
    got = tables.get("company_facts")(spark, str(tmp_path / "f.json")).orderBy("ordinal")
    assert values(got, "namespace", "tag", "unit", "ordinal", "val") == [("us-gaap", "Assets", "USD", 0, 5.0), ("us-gaap", "Assets", "USD", 1, 6.0)]
    assert tables.header_name("12. FOO BAR ") == "foo_bar" and "issuers" in tables.available()


def test_stream_of_events(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = events.deduplicated(events.read_events(spark, str(tmp_path / "in")), "40 days")
    q = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == batch.count()
    q = events.windowed_counts(events.read_events(spark, str(tmp_path / "in"), 10)).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == batch.count()
    assert events.latest_values(batch).count() == batch.select("user_id", "event_type").distinct().count()


def test_owner_windows(spark):
    rules = spark.createDataFrame([("talen", "VST", None, None), ("westrock", "SW", 2024, None), ("exelon", "EXC", None, 2021)], "key string, ticker string, since int, until int")
    rows = [("talen", "VST", 2020), ("talen", "X", 2020), ("westrock", "SW", 2023), ("westrock", "SW", 2024), ("exelon", "EXC", 2021), ("exelon", "EXC", 2022), ("exelon", "EXC", None), ("other", "SW", 1)]
    kept = identity.owner_valid(rules, spark.createDataFrame(rows, "key string, ticker string, year int"))
    assert set(values(kept, "key", "ticker", "year")) == {rows[1], rows[3], rows[4], rows[6], rows[7]}


def test_single_names_resolve_by_the_first_step_that_fits(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    lookup = frame([("sempra", "SRE"), ("steel dynamics", "STLD"), ("southern", "SO")], "key string, ticker string")
    overrides = frame([(0, "kla", "KLAC"), (1, "florida power light", "NEE")], "ordinal int, key string, ticker string")
    names = ["Sempra Energy", "Southern California Gas Co", "KLA Services", "Klamath", "Dynamics Steel, Inc.", "US Steel Corp", "The Co.", "Florida Power & Light Company", "Southern Company"]
    got = {r["name"]: (r["ticker"], r["method"]) for r in identity.resolve(frame([(n,) for n in names], "name string"), lookup, overrides).collect()}
    assert got == {
        "Sempra Energy": ("SRE", "parent-prefix"), "Southern California Gas Co": (None, "unmatched"), "KLA Services": ("KLAC", "override-prefix"), "Klamath": (None, "unmatched"),
        "Dynamics Steel, Inc.": ("STLD", "fuzzy"), "US Steel Corp": (None, "unmatched"), "The Co.": (None, "empty"), "Florida Power & Light Company": ("NEE", "override"), "Southern Company": ("SO", "exact"),
    }
