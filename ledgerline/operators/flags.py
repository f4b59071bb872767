"""Findings: where advice goes, the status that results, and statuses on facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of confidence and of impact (tonnes).
UNCERTAIN, CONFIDENT, LARGE = 0.6, 0.85, 1_000_000.0
#: Statuses by rank.
RANKS = ["ok", "review", "error"]


def route(flag: dict[str, Column], advice: dict[str, Column]) -> Column:
    """automatic, escalation or human.  flag: severity, ranking_relevant, impact; advice: failed, verdict,
    confidence, escalated (whether the stronger reader gave it), action, needs_human."""
    conf = F.coalesce(advice["confidence"], F.lit(0.0))
    unsure = (advice["verdict"] == "unclear") | (conf < UNCERTAIN)
    high = F.coalesce(flag["ranking_relevant"], F.lit(False)) | (F.coalesce(flag["impact"], F.lit(0.0)) >= LARGE)
    disagrees = (flag["severity"] == "error") & (advice["verdict"] == "plausible")
    intervenes = advice["action"].isin("suppress", "correct")
    asks = F.coalesce(advice["needs_human"], F.lit(False)) & (conf < CONFIDENT)
    return (
        F.when(F.coalesce(advice["failed"], F.lit(False)), "human")
        .when(unsure, F.when(advice["escalated"], "human").otherwise("escalation"))
        .when(disagrees | (intervenes & high) | asks, "human")
        .otherwise("automatic")
    )


def status(decision: Column, routed: Column, action: Column, verdict: Column, severity: Column) -> Column:
    """A human decision first; automatic advice may clear a finding or ask for review, never remove a value."""
    said = F.lower(F.trim(F.coalesce(decision, F.lit(""))))
    cleared = (F.lower(F.trim(F.coalesce(action, F.lit("")))) == "keep") & F.coalesce(verdict == "plausible", F.lit(False))
    return (
        F.when(said.isin("error", "suppress", "correct"), "error")
        .when(said.isin("ok", "keep", "plausible"), "ok")
        .when(F.coalesce(routed == "automatic", F.lit(False)), F.when(cleared, "ok").otherwise("review"))
        .otherwise(F.coalesce(severity, F.lit("review")))
    )


def apply_statuses(facts: DataFrame, flags: DataFrame) -> DataFrame:
    """facts (ticker, metric, year, ...) with quality_status, quality_rule and quality_note.

    flags: flag_id, ticker, metric (* stands for all metrics and years), year (missing: all), status, rule, note.  The gravest
    flag of a fact wins, of equals the largest flag_id.  Flags are reduced to one a key before they meet facts."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, RANKS)), F.col("status")), F.lit(0))
    verdict = F.struct(rank.alias("rank"), "flag_id", "status", "rule", "note")
    kinds = [
        (["ticker"], F.col("metric") == "*"),
        (["ticker", "metric"], (F.col("metric") != "*") & F.col("year").isNull()),
        (["ticker", "metric", "year"], (F.col("metric") != "*") & F.col("year").isNotNull()),
    ]
    df = facts
    for k, (key, which) in enumerate(kinds):
        best = flags.where(which).groupBy(*key).agg(F.max(verdict).alias(f"_f{k}")).withColumnsRenamed({c: f"_k{k}_{c}" for c in key})
        same = [F.col(c) == F.col(f"_k{k}_{c}") for c in key]
        df = df.join(best, same, "left").drop(*[f"_k{k}_{c}" for c in key])
    won = F.greatest(*[F.col(f"_f{k}") for k in range(len(kinds))])
    df = df.withColumn("_won", won)
    told = {"quality_status": F.coalesce("_won.status", F.lit("ok")), "quality_rule": F.coalesce("_won.rule", F.lit("")), "quality_note": F.coalesce("_won.note", F.lit(""))}
    return df.withColumns(told).drop("_won", *[f"_f{k}" for k in range(len(kinds))])
