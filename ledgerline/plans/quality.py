"""Ten quality rules with evidence, and constraints, over facts built from the given tables.

Customers stand for issuers (their orders for facility rows of a year), labels for statuses of targets, events for reported rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import constraints, rules
from ledgerline.operators.rules import Grain, Registry, Rule, fixed, listed, text

from .base import Tables, query, r

#: Programs (order priorities) that measure the quantity.
MEASURED = ["1-URGENT", "2-HIGH"]
col = F.col


def _sum_if(condition, x):
    return F.coalesce(F.sum(F.when(condition, x)), F.lit(0.0))


def standard_rules() -> list[Rule]:
    """The rules' names, severities, thresholds and the names of their evidence."""
    status, price = col("o_orderstatus"), col("o_totalprice")
    company_year = {
        "scope1": _sum_if(status == "F", price), "supplied": _sum_if(status == "P", price), "facilities": F.count(F.lit(1)),
        "types": F.array_sort(F.collect_set("o_orderpriority")),
    }
    hours = price / 100
    return [
        Rule(
            "F01_duplicate_cik", "cik", "error", F.lit(True), "*", None, F.concat(F.lit("Shares an issuer with "), col("kept")),
            {"classes": F.array_sort(F.collect_set("ticker")), "included": F.array_sort(F.collect_set(F.when(col("observed"), col("ticker"))))},
            {"cik": text(col("cik")), "share_classes": listed(col("classes"))},
        ),
        Rule(
            "F02_zero_instead_of_missing", "company-year", "error", col("scope1") == 0, "scope1_t", F.lit(0.0),
            F.concat(F.lit("Zero despite a matched facility: "), F.when(col("supplied") > 0, "supplier only").otherwise("recorded without a quantity")), company_year,
            {"facilities": text(col("facilities")), "facility_types": listed(F.slice("types", 1, 4)), "supplied_t": fixed(col("supplied")), "previous_year_t": fixed(col("before")), "scope1_history": col("history")},
            F.coalesce("before", F.lit(0.0)), col("ranked"),
        ),
        Rule(
            "F03_non_measuring_program", "company-year", F.when(F.arrays_overlap("types", F.array(*map(F.lit, MEASURED))), "review").otherwise("error"), (col("exported") > 0) & (col("scope1") <= 0),
            "campd_co2_t", F.lit(0.0), F.when(F.arrays_overlap("types", F.array(*map(F.lit, MEASURED))), "Zero in a measuring program").otherwise("The programs do not measure this quantity"),
            company_year | {"exported": F.count_if(status == "O")}, {"facilities": text(col("facilities")), "programs": listed(col("types")), "last_mwh": fixed(col("supplied"))},
        ),
        Rule(
            "F04_impossible_quarters", "company", "error", col("quarters") > 12 * col("sites"), "quarters", col("quarters"), "More quarters than twelve a facility",
            {"quarters": F.sum(F.month("o_orderdate").cast("double")), "sites": F.size(F.collect_set("o_orderpriority"))}, {"facilities": text(col("sites")), "quarters": fixed(col("quarters"))},
        ),
        Rule(
            "F06_plant_attribution", "company", "review", (col("plants") <= 2) & (col("mwh") >= 1e6) & (col("sector") != "BUILDING"), "egrid_mwh", col("mwh"), "Large plants outside the sector of plants",
            {"plants": F.size(F.collect_set("o_orderstatus")), "mwh": F.sum(price)}, {"plants": text(col("plants")), "mwh": fixed(col("mwh")), "sector": text(col("sector"))},
        ),
        Rule(
            "F08_temporal_attribution", "company-year", "error", col("ruled") & (col("scope1") > 0) & (
                (col("since").isNull() & col("until").isNull()) | F.coalesce(col("year") < col("since"), F.lit(False)) | F.coalesce(col("year") > col("until"), F.lit(False))
            ), "scope1_t", col("scope1"), "The mapping is not valid in this year", company_year, {"facilities": text(col("facilities")), "since": text(col("since")), "until": text(col("until"))}, col("scope1"), col("ranked"),
        ),
        Rule(
            "F09_implausible_hours", "company", "review", (col("hours") < 50_000) | (col("hours") > 350_000) | (col("implausible") > 0.3), "osha_hours", col("all_hours"),
            F.concat(F.lit("Median of hours "), fixed(col("hours") / 100, 0)),
            {"hours": F.median(price), "implausible": F.avg(((hours < 200) | (hours > 4000)).cast("double")), "all_hours": F.sum(price), "reports": F.count(F.lit(1))},
            {"reports": text(col("reports")), "median_hours_per_employee": fixed(col("hours")), "implausible_share": fixed(col("implausible"))},
        ),
        Rule(
            "F10_trade_names", "company", "review", (col("reports") >= 5) & (col("trade_only") / col("reports") >= 0.5), "whd_cases", col("reports"), "Matched by trade name mostly",
            {"reports": F.count(F.lit(1)), "trade_only": F.count_if(status != "F"), "mwh": F.sum(price)},
            {"cases": text(col("reports")), "trade_name_only": text(col("trade_only")), "backwages_usd": fixed(col("mwh"))},
        ),
        Rule(
            "F12_contradiction", "target", "error", (col("validated") == 1) & (col("removed") == 1), "sbti_commitment_removed", F.lit(1.0), "Validated and removed at once",
            {"validated": F.max("quality"), "removed": F.max("toxic")}, {"rule": F.lit("commitment removed")},
        ),
        Rule(
            "P01_sector_extreme", "latest", "review", col("z") > 3.5, col("metric"), col("value"), F.concat(F.lit("Robust z "), fixed(col("z"), 1)), {},
            {"sector": text(col("sector")), "n": text(col("n")), "median": fixed(col("median")), "p90": fixed(col("p90")), "max": fixed(col("most"))},
        ),
    ]


def grains(t: Tables) -> dict[str, Grain]:
    issuers = t.customer.select(col("c_custkey").alias("ticker"), col("c_mktsegment").alias("sector"), (col("c_acctbal") > 5000).alias("ranked"))
    k = col("c_custkey")
    windows = t.customer.where(k % 25 < 3).select(
        k.alias("ticker"), F.when(k % 25 == 0, 1997).alias("since"), F.when(k % 25 == 1, 1999).alias("until"), F.lit(True).alias("ruled")
    )
    orders = t.orders.withColumn("ticker", col("o_custkey")).withColumn("year", F.year("o_orderdate").cast("long"))
    observed = t.orders.select(col("o_custkey").alias("_key"), F.lit(True).alias("observed")).distinct()
    classes = t.customer.join(observed, k == col("_key"), "left").select(
        k.cast("string").alias("ticker"), F.when(k % 10 < 3, k - k % 10).otherwise(k).alias("cik"), F.coalesce("observed", F.lit(False)).alias("observed")
    )
    duplicates = lambda df: df.withColumn("kept", F.try_element_at("included", F.lit(1))).withColumn("ticker", F.explode(F.slice("included", 2, 1_000_000)))
    dated = lambda df: rules.with_history(df, "ticker", "year", "scope1", "before", "history").join(issuers, "ticker", "left").join(windows, "ticker", "left").withColumn("ruled", F.coalesce("ruled", F.lit(False)))
    rates = t.events.where("value > 0").groupBy(col("user_id").alias("ticker"), col("event_type").alias("metric")).agg(
        F.max_by(F.struct((1000 / col("value")).alias("value"), F.year("ts").alias("year")), F.struct("ts", "event_id")).alias("x")
    )
    latest = rates.select("ticker", "metric", "x.value", "x.year").join(issuers, "ticker")
    return {
        "cik": Grain(classes, ["cik"], duplicates),
        "company-year": Grain(orders, ["ticker", "year"], dated),
        "company": Grain(orders, ["ticker"], lambda df: df.join(issuers, "ticker", "left")),
        "target": Grain(t.labels.withColumn("ticker", col("doc_id")), ["ticker"]),
        "latest": Grain(rules.extremes(latest, ["metric", "sector"]), ["ticker"]),
    }


DEC = lambda x: f"coalesce(round({x}, 4)::decimal(30,4)::varchar, '')"
RULES_SQL = f"""with iss as (select c_custkey ticker, c_mktsegment sector, c_acctbal > 5000 ranked from customer),
 win as (select c_custkey ticker, case when c_custkey % 25 = 0 then 1997 end since, case when c_custkey % 25 = 1 then 1999 end until from customer where c_custkey % 25 < 3),
 cy0 as (select o_custkey ticker, year(o_orderdate)::bigint as year, coalesce(sum(o_totalprice) filter (o_orderstatus = 'F'), 0) scope1, coalesce(sum(o_totalprice) filter (o_orderstatus = 'P'), 0) supplied, count(*) facilities, list_sort(list(distinct o_orderpriority)) types, count(*) filter (o_orderstatus = 'O') exported from orders group by 1, 2),
 cy as (select c.*, lag(scope1) over w prev, string_agg(year || ':' || {DEC('scope1')}, ',') over (partition by c.ticker order by year rows between unbounded preceding and unbounded following) history, ranked, since, until, win.ticker is not null ruled from cy0 c left join iss using (ticker) left join win on win.ticker = c.ticker window w as (partition by c.ticker order by year)),
 co as (select o_custkey ticker, sum(month(o_orderdate))::double qtr, count(distinct o_orderpriority) sites, count(distinct o_orderstatus) plants, sum(o_totalprice) mwh, median(o_totalprice) hpe, avg((o_totalprice / 100 < 200 or o_totalprice / 100 > 4000)::double) implausible, count(*) reports, count(*) filter (o_orderstatus <> 'F') trade_only from orders group by 1),
 coi as (select * from co left join iss using (ticker)),
 cls as (select case when c_custkey % 10 < 3 then c_custkey - c_custkey % 10 else c_custkey end cik, list_sort(list(c_custkey::varchar)) classes, list_sort(list(c_custkey::varchar) filter (c_custkey in (select o_custkey from orders))) included from customer group by 1),
 la as (select user_id ticker, event_type metric, arg_max(1000 / value, (ts, event_id)) as value, arg_max(year(ts), (ts, event_id)) as year from events where value > 0 group by 1, 2),
 lg as (select la.*, sector, log10(value) l from la join iss using (ticker)), g1 as (select metric, sector, count(*) n, median(l) mid, median(value) med, quantile_cont(value, 0.9) p90, max(value) most from lg group by 1, 2 having count(*) >= 6),
 g2 as (select *, median(abs(l - mid)) over (partition by metric, sector) mad from lg join g1 using (metric, sector)), ex as (select *, (l - mid) / (1.4826 * case when mad = 0 then 1e-9 else mad end) z from g2),
 f as (select 'F01_duplicate_cik' rule, 'error' severity, unnest(included[2:]) ticker, '*' metric, null::bigint as year, null::double as value, 0.0::double impact, false relevant, 'cik=' || cik || ';share_classes=' || array_to_string(classes, ',') ev from cls
 union all select 'F02_zero_instead_of_missing', 'error', ticker::varchar, 'scope1_t', year, 0.0, coalesce(prev, 0), ranked, 'facilities=' || facilities || ';facility_types=' || array_to_string(types[:4], ',') || ';previous_year_t=' || {DEC('prev')} || ';scope1_history=' || history || ';supplied_t=' || {DEC('supplied')} from cy where scope1 = 0
 union all select 'F03_non_measuring_program', case when list_has_any(types, {MEASURED}) then 'review' else 'error' end, ticker::varchar, 'campd_co2_t', year, 0.0, 0, false, 'facilities=' || facilities || ';last_mwh=' || {DEC('supplied')} || ';programs=' || array_to_string(types, ',') from cy where exported > 0 and scope1 <= 0
 union all select 'F04_impossible_quarters', 'error', ticker::varchar, 'quarters', null, qtr, 0, false, 'facilities=' || sites || ';quarters=' || {DEC('qtr')} from coi where qtr > 12 * sites
 union all select 'F06_plant_attribution', 'review', ticker::varchar, 'egrid_mwh', null, mwh, 0, false, 'mwh=' || {DEC('mwh')} || ';plants=' || plants || ';sector=' || sector from coi where plants <= 2 and mwh >= 1e6 and sector <> 'BUILDING'
 union all select 'F08_temporal_attribution', 'error', ticker::varchar, 'scope1_t', year, scope1, scope1, ranked, 'facilities=' || facilities || ';since=' || coalesce(since::varchar, '') || ';until=' || coalesce(until::varchar, '') from cy where ruled and scope1 > 0 and ((since is null and until is null) or coalesce(year < since, false) or coalesce(year > until, false))
 union all select 'F09_implausible_hours', 'review', ticker::varchar, 'osha_hours', null, mwh, 0, false, 'implausible_share=' || {DEC('implausible')} || ';median_hours_per_employee=' || {DEC('hpe')} || ';reports=' || reports from coi where hpe < 50000 or hpe > 350000 or implausible > 0.3
 union all select 'F10_trade_names', 'review', ticker::varchar, 'whd_cases', null, reports, 0, false, 'backwages_usd=' || {DEC('mwh')} || ';cases=' || reports || ';trade_name_only=' || trade_only from coi where reports >= 5 and trade_only / reports >= 0.5
 union all select 'F12_contradiction', 'error', doc_id::varchar, 'sbti_commitment_removed', null, 1.0, 0, false, 'rule=commitment removed' from labels group by doc_id having max(quality) = 1 and max(toxic) = 1
 union all select 'P01_sector_extreme', 'review', ticker::varchar, metric, year, value, 0, false, 'max=' || {DEC('most')} || ';median=' || {DEC('med')} || ';n=' || n || ';p90=' || {DEC('p90')} || ';sector=' || sector from ex where z > 3.5)
 select 'Q-' || substr(sha256(concat_ws('|', rule, ticker, metric, coalesce(year::varchar, ''), {DEC('value')}, ev)), 1, 16) flag_id, rule, severity, ticker, metric, year, round(value, 4) as value, round(impact, 4) impact, coalesce(relevant, false) ranking_relevant, ev evidence from f"""


@query("q104_rule_findings", RULES_SQL)
def q104(t: Tables) -> DataFrame:
    found = Registry(standard_rules()).findings(grains(t))
    return found.select(
        "flag_id", "rule", "severity", "ticker", "metric", "year", r("value", 4).alias("value"), r("impact", 4).alias("impact"), "ranking_relevant", rules.evidence_text(col("evidence")).alias("evidence")
    )


#: The catalogue of metrics: metric, label, unit, direction, axis, source, kind of value.
CATALOGUE = [
    ("1-URGENT", "urgent", "t", -1, "E", "epa", "aggregated"), ("2-HIGH", "high", "t", -1, "E", "epa", "aggregated"), ("3-MEDIUM", "medium", "usd", 1, "S", "sec", "aggregated"), ("5-LOW", "low", "h", 1, "meta", "osha", "aggregated"),
]
SOURCES = ["epa", "sec"]
OBSERVED = """o as (select o_custkey ticker, o_orderpriority metric, year(o_orderdate)::bigint as year, round(sum(o_totalprice), 2) as value, count(*) n from orders group by 1, 2, 3),
 obs as (select ticker, metric, year, case when ticker % 71 = 0 then 'nan'::double else value end as value, case metric when '3-MEDIUM' then 'sec' when '5-LOW' then 'osha' else 'epa' end source_id, case when ticker % 97 = 0 then 'ftp://x' else 'https://x/' || metric end source_url,
  case metric when '3-MEDIUM' then 'usd' when '5-LOW' then (case when year = 1999 then 'kg' else 'h' end) else 't' end unit, case when ticker % 50 = 7 then 'estimated' when n > 1 then 'aggregated' else 'reported' end value_type,
  case when ticker % 61 = 0 then 'odd' when value < 20000 then 'error' when value < 50000 then 'review' else 'ok' end quality_status, case when ticker % 83 <> 0 then year + 1 end assembled_at, lower(substr(metric, 3)) as label, case when metric in ('1-URGENT', '2-HIGH') then -1 else 1 end direction,
  case metric when '3-MEDIUM' then 'S' when '5-LOW' then 'meta' else 'E' end axis from o)"""


def observations(t: Tables) -> DataFrame:
    """One row a ticker, metric and year with its provenance; some rows break constraints."""
    k, m = col("ticker"), col("metric")
    rows = t.orders.groupBy(col("o_custkey").alias("ticker"), col("o_orderpriority").alias("metric"), F.year("o_orderdate").cast("long").alias("year")).agg(
        r(F.sum("o_totalprice"), 2).alias("value"), F.count(F.lit(1)).alias("n")
    )
    kind = F.when(k % 50 == 7, "estimated").when(col("n") > 1, "aggregated").otherwise("reported")
    status = F.when(k % 61 == 0, "odd").when(col("value") < 20000, "error").when(col("value") < 50000, "review").otherwise("ok")
    by_metric = lambda medium, low, other: F.when(m == "3-MEDIUM", medium).when(m == "5-LOW", low).otherwise(other)
    return rows.select(
        "ticker", "metric", "year", F.when(k % 71 == 0, float("nan")).otherwise(col("value")).alias("value"), by_metric("sec", "osha", "epa").alias("source_id"),
        F.when(k % 97 == 0, "ftp://x").otherwise(F.concat(F.lit("https://x/"), m)).alias("source_url"), by_metric(F.lit("usd"), F.when(col("year") == 1999, "kg").otherwise("h"), F.lit("t")).alias("unit"),
        kind.alias("value_type"), status.alias("quality_status"), F.when(k % 83 != 0, col("year") + 1).alias("assembled_at"), F.lower(F.substring(m, 3, 99)).alias("label"),
        F.when(m.isin("1-URGENT", "2-HIGH"), -1).otherwise(1).alias("direction"), by_metric("S", "meta", "E").alias("axis"),
    )


CATALOGUE_FIELDS = ["label", "unit", "direction", "axis", "source_id", "value_type"]
REQUIRED = ("ticker", "year", "metric", "value", "source_id", "source_url", "unit", "value_type", "quality_status", "assembled_at")
FLAGS = """fl as (select doc_id % 400 flag_id, doc_id % 150 + 1 ticker, list_extract(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], (doc_id % 5 + 1)::int) metric, 1995 + doc_id % 6 as year, case when quality = 1 then 'ok' when toxic = 1 then 'error' else 'review' end status, case when doc_id % 9 = 0 then 'ok' when quality = 1 then 'ok' when toxic = 1 then 'error' else 'review' end final from labels)"""
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def reviewed(t: Tables) -> DataFrame:
    d = col("doc_id")
    status = F.when(col("quality") == 1, "ok").when(col("toxic") == 1, "error").otherwise("review")
    return t.labels.select(
        (d % 400).alias("flag_id"), (d % 150 + 1).alias("ticker"), F.element_at(F.array(*map(F.lit, PRIORITIES)), (d % 5 + 1).cast("int")).alias("metric"), (1995 + d % 6).alias("year"),
        status.alias("status"), F.when(d % 9 == 0, "ok").otherwise(status).alias("final"),
    )


def standard_constraints() -> list[constraints.Constraint]:
    """What the checks of a snapshot are called."""
    c, near = constraints, lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)
    catalogued = col("cat_metric").isNotNull()
    return [
        c.Columns("Missing observation columns", "observations", REQUIRED),
        c.required("Missing required observation metadata", "observations", *REQUIRED),
        c.Unique("Duplicate observations", "observations", ("ticker", "year", "metric")),
        c.Known("Unknown ticker or duplicate share class", "observations", ("ticker",), "issuers", ("ticker",)),
        c.Holds("Non-finite observations", "observations", ~F.isnan("value") & (F.abs("value") < float("inf"))),
        c.within("Unknown value type", "observations", "value_type", ["reported", "aggregated"]),
        c.within("Unknown quality status", "observations", "quality_status", ["ok", "review", "error"]),
        c.Holds("Unregistered metric", "observations", catalogued),
        c.within("Unregistered source", "observations", "source_id", SOURCES),
        *[c.Holds(f"Catalog mismatch: {f}", "observations", col(f) == col(f"cat_{f}"), catalogued) for f in CATALOGUE_FIELDS],
        c.Holds("Invalid source URL", "observations", col("source_url").rlike("^https?://")),
        c.Holds("Derived analysis leaked into observations", "observations", ~col("metric").isin("co2_intensity", "intensity_cagr", "absolute_cagr", "p50")),
        c.Holds("Nonpositive emissions in the retained series", "observations", F.nanvl("value", F.lit(0.0)) > 0, col("axis") == "E"),
        c.Holds("Multiplied history", "pairs", col("quarters") <= 12 * col("facilities")),
        c.Unique("Duplicate bands", "bands", ("ticker",)),
        c.Known("Bands of unknown tickers", "bands", ("ticker",), "issuers", ("ticker",)),
        c.required("Missing percentiles", "bands", "p10", "p50", "p90"),
        c.Holds("Invalid percentile ordering", "bands", (col("p10") >= 0) & (col("p10") <= col("p50")) & (col("p50") <= col("p90")) & (col("p90") <= 100)),
        c.Holds("Band widths do not reconcile", "bands", near(col("band_width"), col("p90") - col("p10"))),
        c.Unique("Duplicate issuers in viability", "economy", ("ticker",)),
        c.SameKeys("Issuer universe mismatch: viability", "economy", ("ticker",), "issuers", ("ticker",)),
        c.SameKeys("Issuer universe mismatch: reliability", "reliability", ("ticker",), "issuers", ("ticker",)),
        c.Unique("Duplicate quality IDs", "flags", ("flag_id",)),
        c.Holds("Review status mismatch", "flags", col("final") == col("status")),
        c.Known("Flag without an observation", "flags", ("ticker", "metric", "year"), "observations", ("ticker", "metric", "year")),
        c.Holds("Stale quality annotation", "flags", col("annotated") == col("status"), col("annotated").isNotNull()),
        c.Holds("Documentation row inside data", "customers", ~col("c_name").startswith("Customer#0000000")),
        c.Columns("Input data dictionary mismatch", "customers", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_segment"), exactly=True),
    ]


def checked_tables(t: Tables) -> dict[str, DataFrame]:
    rows = observations(t)
    fields = ["metric", *CATALOGUE_FIELDS]
    catalogue = t.spark.createDataFrame(CATALOGUE, ["cat_metric", "cat_label", "cat_unit", "cat_direction", "cat_axis", "cat_source_id", "cat_value_type"])
    k, band = col("c_custkey"), (col("c_acctbal") + 1000) / 110
    bands = t.customer.select(
        k.alias("ticker"), (band - 5).alias("p10"), F.when(k % 89 != 0, band).alias("p50"), (band + 6).alias("p90"), F.when(k % 40 == 3, 12.0).otherwise(11.0).alias("band_width")
    )
    pairs = rows.where(~F.isnan("value")).groupBy("ticker", "year").agg(
        F.max(F.when(col("metric") == "1-URGENT", col("value"))).alias("quarters"), F.max(F.when(col("metric") == "2-HIGH", col("value"))).alias("facilities")
    ).dropna()
    noted = rows.select(col("ticker").alias("_t"), col("metric").alias("_m"), col("year").alias("_y"), col("quality_status").alias("annotated"))
    flags = reviewed(t).join(noted, (col("ticker") == col("_t")) & (col("metric") == col("_m")) & (col("year") == col("_y")), "left").drop("_t", "_m", "_y")
    assert len(fields) == len(catalogue.columns)
    return {
        # The catalogue is a few rows of this module.
        "observations": rows.join(F.broadcast(catalogue), col("metric") == col("cat_metric"), "left"), "issuers": t.customer.where(~(k % 10).isin(1, 2)).select(k.alias("ticker")), "bands": bands,
        "pairs": pairs, "economy": t.orders.select(col("o_custkey").alias("ticker")).distinct(), "reliability": t.events.select(col("user_id").alias("ticker")), "flags": flags, "customers": t.customer,
    }


CATALOGUE_SQL = "cat as (select * from (values " + ", ".join(str(x) for x in CATALOGUE) + ") c(metric, label, unit, direction, axis, source_id, value_type))"
COUNTS = {
    "Missing observation columns": "select 0",
    "Missing required observation metadata": "select count(*) from obs where assembled_at is null",
    "Duplicate observations": "select count(*) - count(distinct (ticker, year, metric)) from obs",
    "Unknown ticker or duplicate share class": "select count(*) from obs where ticker not in (select ticker from issu)",
    "Non-finite observations": "select count(*) from obs where not isfinite(value)",
    "Unknown value type": "select count(*) from obs where value_type not in ('reported', 'aggregated')",
    "Unknown quality status": "select count(*) from obs where quality_status not in ('ok', 'review', 'error')",
    "Unregistered metric": "select count(*) from obs where metric not in (select metric from cat)",
    "Unregistered source": "select count(*) from obs where source_id not in ('epa', 'sec')",
    **{f"Catalog mismatch: {f}": f"select count(*) from obs join cat using (metric) where obs.{f} <> cat.{f}" for f in CATALOGUE_FIELDS},
    "Invalid source URL": "select count(*) from obs where not regexp_matches(source_url, '^https?://')",
    "Derived analysis leaked into observations": "select count(*) from obs where metric in ('co2_intensity', 'intensity_cagr', 'absolute_cagr', 'p50')",
    "Nonpositive emissions in the retained series": "select count(*) from obs where axis = 'E' and not (isfinite(value) and value > 0)",
    "Multiplied history": "select count(*) from (select max(value) filter (metric = '1-URGENT') q, max(value) filter (metric = '2-HIGH') f from obs where not isnan(value) group by ticker, year) where q > 12 * f",
    "Duplicate bands": "select 0",
    "Bands of unknown tickers": "select count(*) from customer where c_custkey not in (select ticker from issu)",
    "Missing percentiles": "select count(*) from customer where c_custkey % 89 = 0",
    "Invalid percentile ordering": "select count(*) from customer where c_custkey % 89 = 0 or not ((c_acctbal + 1000) / 110 - 5 >= 0 and (c_acctbal + 1000) / 110 + 6 <= 100)",
    "Band widths do not reconcile": "select count(*) from customer where c_custkey % 40 = 3",
    "Duplicate issuers in viability": "select 0",
    "Issuer universe mismatch: viability": "select (select count(*) from issu where ticker not in (select o_custkey from orders)) + (select count(distinct o_custkey) from orders where o_custkey not in (select ticker from issu))",
    "Issuer universe mismatch: reliability": "select (select count(*) from issu where ticker not in (select user_id from events)) + (select count(distinct user_id) from events where user_id not in (select ticker from issu))",
    "Duplicate quality IDs": "select count(*) - count(distinct flag_id) from fl",
    "Review status mismatch": "select count(*) from fl where final <> status",
    "Flag without an observation": "select count(*) from fl left join obs using (ticker, metric, year) where obs.value is null",
    "Stale quality annotation": "select count(*) from fl join obs using (ticker, metric, year) where quality_status <> status",
    "Documentation row inside data": "select count(*) from customer where starts_with(c_name, 'Customer#0000000')",
    "Input data dictionary mismatch": "select 2",
}


@query(
    "q105_snapshot_constraints",
    f"with {OBSERVED}, {CATALOGUE_SQL}, {FLAGS}, issu as (select c_custkey ticker from customer where c_custkey % 10 not in (1, 2)) " + " union all ".join(f"select '{n}' constraint_name, ({s})::bigint violations" for n, s in COUNTS.items()),
)
def q105(t: Tables) -> DataFrame:
    return constraints.report(checked_tables(t), standard_constraints())


#: Repairs of named cases (fixed values: the topics): topic, ticker (none: all), what must hold of the observations, and what is found.
REPAIRS = [
    ("Zero instead of missing", 4, "count(*) filter (where metric = '1-URGENT' and year = 1997) = 0", "count(*) filter (where metric = '1-URGENT' and year = 1997)"),
    ("Program does not measure", 5, "count(*) filter (where metric = '2-HIGH') = 0", "count(*) filter (where metric = '2-HIGH')"),
    ("Join multiplication", 8, "coalesce(max(value) filter (where metric = '1-URGENT'), 0) <= 12 * coalesce(max(value) filter (where metric = '2-HIGH'), 1)", "max(value) filter (where metric = '1-URGENT')"),
    ("Derived ratio kept separate", 10, "count(*) filter (where metric = 'ratio') = 0", "count(*)"),
    ("Numerator and denominator retained", 13, "count(*) filter (where metric = '3-MEDIUM') > 0 and count(*) filter (where metric = '5-LOW') > 0", "max(value) filter (where metric = '3-MEDIUM')"),
    ("No rate from an unchecked denominator", 14, "count(*) filter (where metric = 'rate') = 0 and count(*) filter (where metric = '5-LOW') > 0", "count(*) filter (where metric = '5-LOW')"),
    ("Substring attribution", 16, "count(*) filter (where metric = '4-NOT SPECIFIED') = 0", "count(*) filter (where metric = '4-NOT SPECIFIED')"),
    ("Derived trend kept separate", 19, "count(*) filter (where metric in ('absolute_cagr', 'intensity_cagr', 'co2_intensity')) = 0 and count(*) > 0", "count(*)"),
    ("Attribution without a validity window", 20, "coalesce(max(value) filter (where metric = '1-URGENT' and year = 1998), 0) < 300000", "max(value) filter (where metric = '1-URGENT' and year = 1998)"),
    ("Duplicate share class", 11, "count(*) = 0", "count(*)"),
    ("All observations carry provenance", None, "count(*) filter (where value_type is null or value_type not in ('reported', 'aggregated')) = 0", "count(*) filter (where value_type = 'reported')"),
]


@query(
    "q106_repair_cases",
    f"with {OBSERVED} " + " union all ".join(
        f"select '{topic}' topic, {'null' if k is None else k}::bigint ticker, {ok} resolved, round(({found})::double, 2) finding from obs" + ("" if k is None else f" where ticker = {k}") for topic, k, ok, found in REPAIRS
    ),
)
def q106(t: Tables) -> DataFrame:
    """All cases in one pass: a ticker's rows are aggregated once, whatever asks for them."""
    tickers = sorted({k for _, k, *_ in REPAIRS if k is not None})
    rows = observations(t)
    named = {f"{what}{i}": F.expr(sql) for i, (_, _, ok, found) in enumerate(REPAIRS) for what, sql in (("ok", ok), ("found", found))}
    whole = rows.groupBy().agg(*[x.alias(n) for n, x in named.items()]).withColumn("ticker", F.lit(None).cast("long"))
    by_ticker = rows.where(col("ticker").isin(*tickers)).groupBy("ticker").agg(*[x.alias(n) for n, x in named.items()])
    # A case without any row is a finding too: aggregates of nothing.
    asked = t.spark.createDataFrame([(k,) for k in tickers], "asked long")
    nothing = rows.where(F.lit(False)).groupBy().agg(*[x.alias(f"no_{n}") for n, x in named.items()])
    held = asked.join(by_ticker, col("asked") == col("ticker"), "left").crossJoin(F.broadcast(nothing))  # one row
    held = held.select(col("asked").alias("ticker"), *[F.when(col("ticker").isNull(), col(f"no_{n}")).otherwise(col(n)).alias(n) for n in named])
    told = lambda i, k: F.struct(F.lit(REPAIRS[i][0]).alias("topic"), F.lit(k).cast("long").alias("ticker"), col(f"ok{i}").alias("resolved"), r(col(f"found{i}").cast("double"), 2).alias("finding"))
    cases = held.unionByName(whole).select(F.inline(F.array_compact(F.array(*[F.when(col("ticker").eqNullSafe(F.lit(k).cast("long")), told(i, k)) for i, (_, k, *_) in enumerate(REPAIRS)]))))
    return cases
