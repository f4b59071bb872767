"""Facts of filings: periods, flows and trailing years, annual series, debt that falls due, three dimensions of viability.

A fact is a row (cik, tag, start, end, val, form, filed); start, end and filed are day numbers, and instants
have no start.  A company's facts of a few tags are a few hundred rows, so what needs their order is done on arrays
inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import ramp
from ledgerline.operators.dedupe import keep_first

#: Lengths and distances in days.
YEAR, PART, STALE, NEAR = (350, 380), (80, 300), 400, 10
#: Ramps of the dimensions, the floor of a dimension's score, levels by the weakest dimension.
RAMPS = {"positive": (0.5, 1.0), "covered": (0.5, 0.9), "coverage": (0.25, 1.0), "interest": (0.5, 0.1), "due": (1.5, 0.5)}
FLOOR, LEVELS, HISTORY, LEAST_YEARS = 0.02, ((0.6, "viable"), (0.25, "strained")), 10, 3


def merge_predecessors(facts: DataFrame, predecessors: DataFrame) -> DataFrame:
    """facts with those of predecessors (predecessor, cik) under their successors."""
    was = predecessors.select(F.col("predecessor").alias("_was"), F.col("cik").alias("_now"))
    return facts.join(was, F.col("cik") == F.col("_was"), "left").withColumn("cik", F.coalesce("_now", "cik")).drop("_was", "_now")


def latest_by_period(facts: DataFrame) -> DataFrame:
    """One fact a company, tag and period: another value than 0 first, then the latest filed."""
    return keep_first(facts, ["cik", "tag", "start", "end"], [F.col("val") == 0, F.desc("filed"), F.col("form"), F.col("val")])


def _annual(f: Column) -> Column:
    return (f["n"] >= YEAR[0]) & (f["n"] <= YEAR[1]) & ~f["form"].startswith("10-Q")


def flows(facts: DataFrame) -> DataFrame:
    """cik, tag, fy, fy_end, prior_fy, ttm, ttm_end, method of every tag with a usable period.

    The trailing year is the fiscal year plus the latest year to date minus its counterpart a year before; without a
    usable fiscal year the latest year to date is annualised.  Of equal ends the later start counts."""
    rows = latest_by_period(facts.where(F.col("start").isNotNull())).withColumn("n", F.col("end") - F.col("start"))
    df = rows.groupBy("cik", "tag").agg(F.sort_array(F.collect_list(F.struct("end", "start", "n", "val", "form"))).alias("f"))
    part = lambda f: (f["n"] >= PART[0]) & (f["n"] <= PART[1])
    df = df.withColumns({"annual": F.filter("f", _annual), "parts": F.filter("f", part)})
    df = df.withColumns({"year": F.try_element_at("annual", F.lit(-1)), "newest": F.try_element_at("parts", F.lit(-1))["end"]})
    usable = F.col("year").isNotNull() & F.coalesce(F.col("newest") - F.col("year.end") <= STALE, F.lit(True))
    prior = F.filter("annual", lambda f: (F.col("year.end") - f["end"]).between(*YEAR))
    longest = F.array_max(F.transform(F.filter("parts", lambda f: f["end"] == F.col("newest")), lambda f: F.struct(f["n"], f["val"])))
    following = F.filter("parts", lambda f: (f["end"] > F.col("year.end")) & (F.abs(f["start"] - F.col("year.end") - 1) <= 7))
    latest = F.array_max(F.transform(following, lambda f: F.struct(f["end"], f["n"], f["val"])))
    df = df.withColumns({"usable": usable, "prior": F.try_element_at(prior, F.lit(-1))["val"], "ytd": longest, "cur": latest})
    like = F.filter("f", lambda f: (F.abs(F.col("cur.end") - f["end"] - 365) <= NEAR) & (F.abs(f["n"] - F.col("cur.n")) <= NEAR))
    comparable = F.array_min(F.transform(like, lambda f: F.struct(F.abs(F.col("cur.end") - f["end"] - 365).alias("off"), f["start"], f["val"])))["val"]
    df = df.withColumn("comparable", F.when(F.col("usable") & F.col("cur").isNotNull(), comparable)).where(F.col("usable") | F.col("ytd").isNotNull())
    moved = F.col("comparable").isNotNull()
    pick = lambda a, b, c: F.when(~F.col("usable"), a).when(moved, b).otherwise(c)
    return df.select(
        "cik", "tag", F.when(F.col("usable"), F.col("year.val")).alias("fy"), F.when(F.col("usable"), F.col("year.end")).alias("fy_end"), F.when(F.col("usable"), F.col("prior")).alias("prior_fy"),
        pick(F.col("ytd.val") * 365 / F.col("ytd.n"), F.col("year.val") + F.col("cur.val") - F.col("comparable"), F.col("year.val")).alias("ttm"),
        pick(F.col("newest"), F.col("cur.end"), F.col("year.end")).alias("ttm_end"), pick(F.lit("annualised YTD"), F.lit("FY + YTD"), F.lit("fiscal year")).alias("method"),
    )


def best_flow(found: DataFrame, tags: list[str], largest: bool = False) -> DataFrame:
    """One flow a company: newest data, not annualised, the newest fiscal year, then the first tag (or the largest amount)."""
    prio = F.array_position(F.array(*map(F.lit, tags)), F.col("tag"))
    tie = F.abs("ttm") if largest else -prio.cast("double")
    own = [c for c in found.columns if c != "cik"]
    best = F.max_by(F.struct(*own), F.struct("ttm_end", F.col("method") != "annualised YTD", F.coalesce("fy_end", F.lit(-1_000_000)), tie, -prio))
    return found.where(prio > 0).groupBy("cik").agg(best.alias("b")).select("cik", "b.*")


def best_flows(found: DataFrame, wanted: dict[str, list[str]], largest: tuple[str, ...] = ()) -> DataFrame:
    """cik and for every name its best flow's ttm, among its tags as in best_flow(): all in one grouping."""
    columns = []
    for name, tags in wanted.items():
        prio = F.array_position(F.array(*map(F.lit, tags)), F.col("tag"))
        tie = F.abs("ttm") if name in largest else -prio.cast("double")
        order = F.struct(F.col("ttm_end"), F.col("method") != "annualised YTD", F.coalesce("fy_end", F.lit(-1_000_000)), tie, -prio)
        columns.append(F.max_by("ttm", F.when(prio > 0, order)).alias(name))
    return found.groupBy("cik").agg(*columns)


def instant_maps(facts: DataFrame, tags: list[str]) -> DataFrame:
    """cik and for every tag a map of dates to the latest filed value, empty without any: all in one grouping."""
    rows = facts.where(F.col("start").isNull() & F.col("tag").isin(*tags))
    rows = keep_first(rows, ["cik", "tag", "end"], [F.desc("filed"), F.col("form"), F.col("val")])
    return rows.groupBy("cik").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("tag") == t, F.struct("end", "val")))).alias(t) for t in tags])


def first_there(maps: list[Column]) -> Column:
    """The first map that isn't empty: a taxonomy's own tag before another's."""
    out = maps[-1]
    for m in reversed(maps[:-1]):
        out = F.when(F.size(m) > 0, m).otherwise(out)
    return out


def annual_series(facts: DataFrame, tags: list[str], years: int = HISTORY) -> DataFrame:
    """cik and series, array<struct<end, val>> of the last fiscal years: of an end the first tag, of ends closer than 300 days the newer."""
    prio = F.array_position(F.array(*map(F.lit, tags)), F.col("tag"))
    rows = latest_by_period(facts.where(F.col("start").isNotNull() & (prio > 0))).withColumn("prio", prio)
    rows = rows.where((F.col("end") - F.col("start")).between(*YEAR) & ~F.col("form").startswith("10-Q"))
    rows = keep_first(rows, ["cik", "end"], [F.col("prio"), F.desc("start")])
    sorted_ = rows.groupBy("cik").agg(F.sort_array(F.collect_list(F.struct("end", "val"))).alias("all"))
    begin = F.expr("cast(array() as array<struct<end:bigint,val:double>>)")

    def step(acc: Column, x: Column) -> Column:
        close = (F.size(acc) > 0) & (x["end"] - F.try_element_at(acc, F.lit(-1))["end"] < 300)
        return F.concat(F.when(close, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc), F.array(x))

    kept = F.aggregate("all", begin, step)
    return sorted_.select("cik", kept.alias("kept")).select("cik", F.slice("kept", F.greatest(F.lit(1), F.size("kept") - years + 1), F.lit(years)).alias("series"))


def instants(facts: DataFrame, tag: str) -> DataFrame:
    """cik, end, val: the latest filed value of every date."""
    rows = facts.where(F.col("start").isNull() & (F.col("tag") == tag))
    return keep_first(rows, ["cik", "end"], [F.desc("filed"), F.col("form"), F.col("val")]).select("cik", "end", "val")


def worst_shortfall(series: Column, assets: Column) -> Column:
    """struct(end, share, pairs): the largest fall from one year to the next as a share of the assets before it (map of end to
    value), over pairs of ends 330 to 400 days apart; of equal falls the earliest."""
    n = F.size(series)
    at = lambda k: F.element_at(series, k)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(at(k).alias("a"), at(k + 1).alias("b"), F.try_element_at(assets, at(k)["end"]).alias("base"))))
    pairs = F.filter(F.coalesce(pairs, F.expr("array()")), lambda p: (p["base"] > 0) & (p["b"]["end"] - p["a"]["end"]).between(330, 400))
    falls = F.transform(pairs, lambda p: F.struct((F.greatest(p["a"]["val"] - p["b"]["val"], F.lit(0.0)) / p["base"]).alias("share"), (-p["b"]["end"]).alias("order")))
    worst = F.array_max(falls)
    return F.struct((-worst["order"]).alias("end"), worst["share"].alias("share"), F.size(pairs).alias("pairs"))


def due_within_year(current: Column, long_term: Column, schedule: Column, short: list[Column]) -> Column:
    """Current debt as reported, else long-term debt that falls due (else the schedule's next year) with short-term borrowings."""
    lt = F.coalesce(long_term, schedule)
    parts = [lt, *short]
    summed = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(lt, F.lit(0.0)))
    return F.coalesce(current, F.when(F.coalesce(*parts).isNotNull(), summed))


def mean_of(parts: list[Column]) -> Column:
    """Mean of those that are there."""
    there = F.array_compact(F.array(*parts))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


def viability(df: DataFrame) -> DataFrame:
    """df with the row of a member: scores, index, weakest, level, and what they follow from, from series and dna (arrays of end and
    val), assets (map), assets_now, ocf, cash, due, interest, revenue, operating, costs, depreciation, labor (trailing years), and
    excluded (a level, or missing) with its note.  Excluded members have no scores and nothing that follows from them."""
    n = F.size("series")
    positive = F.size(F.filter("series", lambda x: x["val"] > 0))
    dna = F.map_from_entries("dna")
    paired = F.filter("series", lambda x: F.map_contains_key(dna, x["end"]))
    covered = F.size(F.filter(paired, lambda x: x["val"] >= F.element_at(dna, x["end"])))
    recent_years = F.slice("series", F.greatest(F.lit(1), n - 2), F.lit(3))
    recent = F.when(F.col("ocf") <= 0, 0.0).when(F.col("ocf") > 0, F.when(F.forall(recent_years, lambda x: x["val"] > 0), 1.0).otherwise(0.5))
    generation = mean_of([F.when(n >= LEAST_YEARS, ramp(positive / n, *RAMPS["positive"])), F.when(F.size(paired) >= LEAST_YEARS, ramp(covered / F.size(paired), *RAMPS["covered"])), recent])
    df = df.withColumns({"years": n, "positive_years": positive, "cash_generation": generation, "worst": worst_shortfall(F.col("series"), F.col("assets"))})
    shock = F.when((F.col("worst.pairs") >= LEAST_YEARS - 1), F.col("ocf") - F.col("worst.share") * F.col("assets_now"))
    df = df.withColumn("shock", shock).withColumn("shock_absorption", F.when(F.col("shock") >= 0, 1.0).when(F.col("shock") < 0, ramp(F.col("cash") / -F.col("shock"), *RAMPS["coverage"])))
    before = F.col("ocf") + F.abs("interest")
    interest = F.when(before > 0, F.abs("interest") / before).when(before <= 0, 1.0)
    available = F.col("cash") + F.greatest(F.coalesce("ocf", F.lit(0.0)), F.lit(0.0))
    ratio = F.when(available > 0, F.col("due") / available).when(available <= 0, F.when(F.col("due") == 0, 0.0).when(F.col("due").isNotNull(), float("inf")))
    df = df.withColumns({"interest_share": interest, "due_ratio": ratio})
    df = df.withColumn("debt_service", mean_of([ramp(F.col("interest_share"), *RAMPS["interest"]), ramp(F.when(F.col("due_ratio").isNotNull(), F.least("due_ratio", F.lit(10.0))), *RAMPS["due"])]))
    names = ["cash_generation", "shock_absorption", "debt_service"]
    ok = F.col("excluded").isNull()
    df = df.withColumns({c: F.when(ok, F.col(c)) for c in names})
    there = F.array_compact(F.array(*names))
    enough = F.size(there) >= 2
    index = F.round(100 * F.exp(F.aggregate(there, F.lit(0.0), lambda a, x: a + F.log(F.greatest(x, F.lit(FLOOR)))) / F.size(there)), 1)
    least = F.array_min(there)
    weakest = F.coalesce(*[F.when(F.col(c) == least, c) for c in names])
    level = F.lit("at risk")
    for bound, name in reversed(LEVELS):
        level = F.when(least >= bound, name).otherwise(level)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in names]))
    notes = F.array_compact(F.array(
        F.when(n < LEAST_YEARS, F.format_string("only %d fiscal year(s) of history", n)),
        F.when(enough & (F.size(missing) > 0), F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
    ))
    shown = lambda x: F.when(ok, x)
    billions = lambda x: shown(F.round(x / 1e9, 2))
    spent = F.coalesce(F.col("revenue") - F.col("operating"), F.col("costs")) - F.coalesce("depreciation", F.lit(0.0))
    positive_now = F.when(recent == 1.0, "yes").when(recent == 0.5, "partly").when(recent == 0.0, "no")
    return df.withColumns({
        "index_value": F.when(ok & enough, index), "weakest": F.when(ok & enough, weakest), "level": F.when(~ok, F.col("excluded")).when(enough, level).otherwise("not assessable"),
        "record": shown(F.format_string("%d/%d", F.col("positive_years"), F.col("years"))),
        "due_text": shown(F.when(F.col("due_ratio") == float("inf"), "inf").when(F.col("due_ratio").isNotNull(), F.format_string("%.2f", F.round("due_ratio", 2)))),
        "covers": shown(F.when(F.size(paired) > 0, F.format_string("%d/%d", covered, F.size(paired)))), "positive_now": shown(positive_now),
        "worst_pct": shown(F.round(100 * F.col("worst.share"), 1)), "worst_end": shown(F.col("worst.end")), "ocf_bn": billions(F.col("ocf")), "shock_bn": billions(F.col("shock")),
        "cash_bn": billions(F.col("cash")), "coverage": shown(F.round(F.when(F.col("shock") < 0, F.col("cash") / -F.col("shock")), 2)), "interest_pct": shown(F.round(100 * F.col("interest_share"), 1)),
        "due_bn": billions(F.col("due")), "cash_months": shown(F.round(F.when(spent > 0, F.col("cash") / (spent / 12)), 1)), "labor_bn": billions(F.col("labor")),
        "notes": F.when(ok, F.array_join(notes, "; ")).otherwise(F.coalesce("excluded_note", F.lit(""))),
    })
