"""Rules and constraints: findings bound to their evidence, one pass a grain and a table."""

import math
import re
from statistics import median

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import constraints, rules
from ledgerline.operators.rules import Grain, Registry, Rule, fixed, text
from ledgerline.plans import quality
from ledgerline.plans.base import Tables

SF = "/root/testdata/sf0.001"


def few(**change):
    base = {
        "name": "R1", "grain": "company", "severity": "error", "when": F.col("cases") >= 2, "metric": "cases", "value": F.col("cases").cast("double"), "message": "many",
        "facts": {"cases": F.count(F.lit(1)), "total": F.sum("x")}, "evidence": {"cases": text(F.col("cases")), "total": fixed(F.col("total"))},
    }
    return Rule(**(base | change))


def run(registry, rows, spark):
    df = spark.createDataFrame(rows, "ticker string, x double")
    return {r["ticker"]: r for r in registry.findings({"company": Grain(df, ["ticker"])}).collect()}


def test_ids_are_bound_to_the_evidence(spark):
    rows = [("A", 1.0), ("A", 2.5), ("B", 1.0), ("C", None), ("C", 4.0)]
    first = run(Registry([few()]), rows, spark)
    assert set(first) == {"A", "C"} and first["A"]["evidence"] == {"cases": "2", "total": "3.5000"} and re.fullmatch("Q-[0-9a-f]{16}", first["A"]["flag_id"])
    turned = few(evidence={"total": fixed(F.col("total")), "cases": text(F.col("cases"))})
    again = run(Registry([turned]), rows[::-1], spark)  # other orders of rows and of evidence
    assert {k: r["flag_id"] for k, r in again.items()} == {k: r["flag_id"] for k, r in first.items()}
    changed = run(Registry([few()]), [("A", 1.0), ("A", 2.6), *rows[2:]], spark)
    assert changed["A"]["flag_id"] != first["A"]["flag_id"] and changed["C"]["flag_id"] == first["C"]["flag_id"]
    other = run(Registry([few(value=F.col("total"))]), rows, spark)
    assert other["A"]["flag_id"] != first["A"]["flag_id"]


def test_a_rule_more_costs_no_pass_more(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", -2.0), ("B", 3.0)], "ticker string, x double")
    plan = lambda registry: registry.findings({"company": Grain(df, ["ticker"])})._jdf.queryExecution().executedPlan().toString()
    one = Registry([few()])
    two = Registry([few(), few(name="R2", severity="review", when=F.col("least") < 0, facts={"least": F.min("x"), "cases": F.count(F.lit(1))}, evidence={}, value=None)])
    assert plan(one).count("Exchange hashpartitioning") == plan(two).count("Exchange hashpartitioning") == 1
    found = two.findings({"company": Grain(df, ["ticker"])}).collect()
    assert {(r["rule"], r["ticker"], r["value"]) for r in found} == {("R1", "A", 2.0), ("R2", "A", None)}


def test_declarations_are_checked(spark):
    with pytest.raises(ValueError, match="already"):
        Registry([few(), few()])
    with pytest.raises(ValueError, match="severity"):
        Registry([few(severity="odd")])
    with pytest.raises(ValueError, match="otherwise"):
        run(Registry([few(), few(name="R2", facts={"cases": F.sum("x")})]), [("A", 1.0)], spark)
    with pytest.raises(ValueError, match="no rows"):
        run(Registry([few(), few(name="R2", grain="other")]), [("A", 1.0)], spark)


def test_extremes_against_a_brute_force(spark):
    rows = [(f"t{i}", "m", "s" if i < 30 else "u", float(1.5 ** (i % 7)) if i != 5 else 1e6) for i in range(34)] + [("z", "m", "s", 0.0), ("y", "m", "s", None)]
    got = {r["ticker"]: r["z"] for r in rules.extremes(spark.createDataFrame(rows, "ticker string, metric string, sector string, value double"), ["metric", "sector"]).collect()}
    logs = {t: math.log10(v) for t, _, s, v in rows if s == "s" and v}
    mid = median(logs.values())
    mad = median(abs(x - mid) for x in logs.values())
    assert set(got) == set(logs) and all(abs(got[t] - (x - mid) / (1.4826 * mad)) < 1e-9 for t, x in logs.items())


def test_history_and_the_year_before(spark):
    df = spark.createDataFrame([("A", 2020, 1.0), ("A", 2018, 0.5), ("B", 2019, None)], "ticker string, year int, v double")
    got = {(r["ticker"], r["year"]): (r["before"], r["history"]) for r in rules.with_history(df, "ticker", "year", "v", "before", "history").collect()}
    assert got == {("A", 2018): (None, "2018:0.5000,2020:1.0000"), ("A", 2020): (0.5, "2018:0.5000,2020:1.0000"), ("B", 2019): (None, "2019:")}


def test_standard_rules_all_fire_and_scan_once_a_grain(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    found = Registry(quality.standard_rules()).findings(quality.grains(t))
    assert {r["rule"] for r in found.select("rule").distinct().collect()} >= {r.name for r in quality.standard_rules()} - {"F04_impossible_quarters", "F06_plant_attribution"}
    assert found.count() == found.select("flag_id").distinct().count()


# ---------------------------------------------------------------- constraints


@pytest.fixture(scope="module")
def tables(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", None), (2, "x", -1.0), (None, "z", 5.0)], "k int, kind string, v double")
    b = spark.createDataFrame([(1, "x"), (3, "x"), (3, "x")], "id int, kind string")
    return {"a": a, "b": b}


def test_constraints_count_violations(spark, tables):
    c = constraints
    asked = [
        c.required("keys", "a", "k", "v"), c.within("kinds", "a", "kind", ["x", "y"]), c.Holds("positive", "a", F.col("v") > 0), c.Holds("positive x", "a", F.col("v") > 0, F.col("kind") == "x"),
        c.Known("known", "a", ("k",), "b", ("id",)), c.Known("known pair", "a", ("k", "kind"), "b", ("id", "kind")), c.Unique("unique", "a", ("k",)), c.Unique("unique b", "b", ("id", "kind")),
        c.SameKeys("same", "a", ("k",), "b", ("id",)), c.Columns("columns", "a", ("k", "w")), c.Columns("exactly", "a", ("k", "w"), exactly=True),
    ]
    got = {r["constraint_name"]: r["violations"] for r in c.report(tables, asked).collect()}
    assert got == {
        "keys": 2, "kinds": 1, "positive": 2, "positive x": 1, "known": 2, "known pair": 3, "unique": 1, "unique b": 1, "same": 3, "columns": 1, "exactly": 3,
    }
    with pytest.raises(ValueError):
        c.report(tables, [asked[0], asked[0]])


def test_row_checks_of_a_table_are_one_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    checks = [constraints.Holds(f"c{k}", "orders", F.col("o_totalprice") > k) for k in range(10)] + [constraints.required("r", "orders", "o_custkey")]
    plan = constraints.report({"orders": orders}, checks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "o_custkey" in plan


def test_checks_while_a_table_is_written(spark, tables, tmp_path):
    df, watch = constraints.observed(tables["a"], [constraints.required("keys", "a", "k"), constraints.Holds("positive", "a", F.col("v") > 0)])
    df.write.parquet(str(tmp_path / "out"))
    assert watch.get == {"keys": 1, "positive": 2}


def test_empty_tables_break_nothing(spark, tables):
    none = {k: df.where("false") for k, df in tables.items()}
    asked = [constraints.required("keys", "a", "k"), constraints.Known("known", "a", ("k",), "b", ("id",)), constraints.Unique("unique", "a", ("k",)), constraints.SameKeys("same", "a", ("k",), "b", ("id",))]
    assert {r["violations"] for r in constraints.report(none, asked).collect()} == {0}
