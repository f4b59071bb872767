"""Quality rules as declarations: what each needs of a grain, when it fires, and the evidence it leaves.

A registry compiles to one grouped pass for each grain (issuer, company and year, ...): the facts of all rules of a grain are
aggregated together, and a row's findings are an array that is filtered and inlined.  A finding is typed: rule, severity, ticker,
metric, year, value, message, impact, whether it bears on a ranking, and a map of evidence.  Its id is a digest of the
rule, what it is about and the evidence, so a decision on a finding lapses when its evidence changes, and holds when
rows or the order of evidence change."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities of findings.
SEVERITIES = ("error", "review")


@dataclass(frozen=True)
class Rule:
    """facts: aggregates of the grain's rows; the other columns are said over facts, keys and what the grain adds afterwards."""

    name: str
    grain: str
    severity: str | Column
    when: Column
    metric: str | Column
    value: Column | None
    message: str | Column
    facts: dict[str, Column] = field(default_factory=dict)
    evidence: dict[str, Column] = field(default_factory=dict)
    impact: Column | None = None
    relevant: Column | None = None


@dataclass(frozen=True)
class Grain:
    """Rows that are grouped by keys; after: what is joined or derived once they are grouped."""

    rows: DataFrame
    keys: list[str]
    after: Callable[[DataFrame], DataFrame] = lambda df: df


def fixed(x: Column, digits: int = 4) -> Column:
    """A number as text that doesn't depend on how an engine writes doubles; empty for none."""
    return F.coalesce(F.round(x, digits).cast(f"decimal(30,{digits})").cast("string"), F.lit(""))


def text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def listed(xs: Column) -> Column:
    return F.array_join(xs, ",")


def _lit(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def evidence_text(evidence: Column) -> Column:
    """name=value;... in the order of names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(evidence)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def finding_id(rule: Column, ticker: Column, metric: Column, year: Column, value: Column, evidence: Column) -> Column:
    said = F.concat_ws("|", rule, text(ticker), metric, text(year), fixed(value), evidence_text(evidence))
    return F.concat(F.lit("Q-"), F.substring(F.sha2(said, 256), 1, 16))


class Registry:
    """Rules by name, in order; a rule that is added takes part from then on."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules: dict[str, Rule] = {}
        for rule in rules or []:
            self.add(rule)

    def add(self, rule: Rule) -> Rule:
        if rule.name in self.rules:
            raise ValueError(f"there is a rule {rule.name} already")
        if isinstance(rule.severity, str) and rule.severity not in SEVERITIES:
            raise ValueError(f"{rule.name}: severity {rule.severity}")
        self.rules[rule.name] = rule
        return rule

    def facts(self, grain: str) -> dict[str, Column]:
        """The facts of all rules of a grain; rules share a fact by its name and must mean the same by it."""
        out: dict[str, Column] = {}
        for rule in self.rules.values():
            for name, fact in rule.facts.items() if rule.grain == grain else ():
                if name in out and str(out[name]) != str(fact):
                    raise ValueError(f"{rule.name}: another rule says {name} otherwise")
                out[name] = fact
        return out

    def findings(self, grains: dict[str, Grain]) -> DataFrame:
        """flag_id, rule, severity, ticker, metric, year, value, message, impact, ranking_relevant, evidence of all rules."""
        parts = []
        for name, grain in grains.items():
            rules = [r for r in self.rules.values() if r.grain == name]
            if not rules:
                continue
            facts = self.facts(name)
            rows = grain.rows.groupBy(*grain.keys).agg(*[fact.alias(n) for n, fact in facts.items()]) if facts else grain.rows
            parts.append(self._found(grain.after(rows), rules))
        if unknown := {r.grain for r in self.rules.values()} - set(grains):
            raise ValueError(f"no rows for {sorted(unknown)}")
        found = reduce(DataFrame.unionByName, parts)
        columns = [F.col(c) for c in ("rule", "ticker", "metric", "year", "value", "evidence")]
        return found.select(finding_id(*columns).alias("flag_id"), *found.columns)

    @staticmethod
    def _found(df: DataFrame, rules: list[Rule]) -> DataFrame:
        ticker = text(F.col("ticker"))
        year = F.col("year").cast("long") if "year" in df.columns else F.lit(None).cast("long")

        def finding(rule: Rule) -> Column:
            pairs = [x for name in sorted(rule.evidence) for x in (F.lit(name), rule.evidence[name])]
            return F.struct(
                F.lit(rule.name).alias("rule"), _lit(rule.severity).alias("severity"), ticker.alias("ticker"), _lit(rule.metric).alias("metric"), year.alias("year"),
                (F.lit(None) if rule.value is None else rule.value).cast("double").alias("value"), _lit(rule.message).alias("message"),
                F.coalesce(F.lit(0.0) if rule.impact is None else rule.impact.cast("double"), F.lit(0.0)).alias("impact"),
                F.coalesce(F.lit(False) if rule.relevant is None else rule.relevant, F.lit(False)).alias("ranking_relevant"),
                (F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")).alias("evidence"),
            )

        return df.select(F.inline(F.array_compact(F.array(*[F.when(rule.when, finding(rule)) for rule in rules]))))


def with_history(df: DataFrame, key: str, year: str, value: str, before: str, history: str) -> DataFrame:
    """df with the value of the year before (of those there are) and all years' values, year:value in order; a key has a row a year."""
    order = Window.partitionBy(key).orderBy(year)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    said = F.concat(F.col(year).cast("string"), F.lit(":"), fixed(F.col(value)))
    return df.withColumn(before, F.lag(value).over(order)).withColumn(history, listed(F.collect_list(said).over(whole)))


def extremes(latest: DataFrame, group: list[str], least: int = 6) -> DataFrame:
    """latest (ticker, value, group) of positive values with z, their robust z on a log scale in groups of `least` values or more,
    and n, median, p90 and most of the group.  Two grouped passes; statistics have one row a group."""
    logs = latest.where("value > 0").withColumn("_log", F.log10("value"))
    first = logs.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.median("_log").alias("_mid"), F.median("value").alias("median"), F.percentile("value", F.lit(0.9)).alias("p90"), F.max("value").alias("most")
    ).where(F.col("n") >= least)
    near = logs.join(first, group)
    spread = near.groupBy(*group).agg(F.median(F.abs(F.col("_log") - F.col("_mid"))).alias("_mad"))
    mad = F.when(F.col("_mad") == 0, 1e-9).otherwise(F.col("_mad"))
    return near.join(spread, group).withColumn("z", (F.col("_log") - F.col("_mid")) / (1.4826 * mad)).drop("_log", "_mid", "_mad")
