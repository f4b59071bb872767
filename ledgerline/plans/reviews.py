"""Evidence, rules, statuses, filings, viability, names, texts and tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import ramp
from ledgerline.operators import flags, identity, ranking, similar, stats
from ledgerline.operators.dedupe import keep_first

from .base import Tables, query, r
from .facts import KINDS

EVIDENCE = {"click": ("engagement", 0.5), "view": ("engagement", 0.3), "purchase": ("commerce", 1.0), "signup": ("identity", 0.8), "error": ("quality", 0.4)}
EVIDENCE_SQL = "ev as (select * from (values " + ", ".join(f"('{k}', '{f}', {w}::double)" for k, (f, w) in EVIDENCE.items()) + ") e(event_type, family, weight))"
LEVELS = f"""{EVIDENCE_SQL}, fam as (select user_id, family, max(case when value > 60 then weight end) w from events join ev using (event_type) group by 1, 2),
 sums as (select user_id, round(coalesce(sum(w), 0), 6) score, count(w) families, coalesce(max(w) >= 0.8, false) anchor from fam group by 1),
 lvl as (select *, case when score <= 0 then 'none' when anchor and families >= 2 and score >= 1.5 then 'strong' when anchor or score >= 1.0 then 'partial' else 'thin' end as level from sums)"""


def levels(t: Tables) -> DataFrame:
    """user_id, score, families, anchor, level: the best weight of each family of evidence counts once; an anchor alone is partial."""
    rows = F.array(*[F.struct(F.lit(k).alias("event_type"), F.lit(f).alias("family"), F.lit(w).alias("weight")) for k, (f, w) in EVIDENCE.items()])
    dim = t.spark.range(1).select(F.inline(rows))
    fam = t.events.join(F.broadcast(dim), "event_type").groupBy("user_id", "family").agg(F.max(F.when(F.col("value") > 60, F.col("weight"))).alias("w"))
    g = fam.groupBy("user_id").agg(r(F.coalesce(F.sum("w"), F.lit(0.0))).alias("score"), F.count("w").alias("families"), F.coalesce(F.max("w") >= 0.8, F.lit(False)).alias("anchor"))
    strong = F.col("anchor") & (F.col("families") >= 2) & (F.col("score") >= 1.5)
    level = F.when(F.col("score") <= 0, "none").when(strong, "strong").when(F.col("anchor") | (F.col("score") >= 1.0), "partial").otherwise("thin")
    return g.select("user_id", "score", "families", "anchor", level.alias("level"))


@query("q31_evidence_levels", f"with {LEVELS} select * from lvl")
def q31(t: Tables) -> DataFrame:
    return levels(t)


@query(
    "q32_evidence_funnel_rollup",
    f"with {LEVELS} select level, c_mktsegment sector, count(*) n, grouping(level)::bigint g_level, grouping(c_mktsegment)::bigint g_sector from lvl join customer on c_custkey = user_id group by rollup (level, c_mktsegment)",
)
def q32(t: Tables) -> DataFrame:
    joined = levels(t).join(t.customer, F.col("c_custkey") == F.col("user_id")).withColumnRenamed("c_mktsegment", "sector")
    return joined.rollup("level", "sector").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("level").cast("bigint").alias("g_level"), F.grouping("sector").cast("bigint").alias("g_sector")
    )


def _days(t: Tables) -> DataFrame:
    """custkey, day (as a number), val: one filing a customer and day."""
    day = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("bigint")
    return t.orders.groupBy(F.col("o_custkey").alias("custkey"), day.alias("day")).agg(F.max("o_totalprice").alias("val"))


@query(
    "q39_fiscal_collapse_last10",
    """with recursive d as (select o_custkey custkey, datediff('day', date '1995-01-01', o_orderdate::date)::bigint as day, max(o_totalprice) val from orders group by 1, 2),
 k as (select custkey, max(day) as day from d group by 1 union all select k.custkey, (select max(d.day) from d where d.custkey = k.custkey and d.day <= k.day - 300) from k where exists (select 1 from d where d.custkey = k.custkey and d.day <= k.day - 300)),
 n as (select *, row_number() over (partition by custkey order by day desc) as i from k)
 select n.custkey, n.day, val as value from n join d on d.custkey = n.custkey and d.day = n.day where i <= 10""",
)
def q39(t: Tables) -> DataFrame:
    # From the newest filing back: one closer than 300 days to the last kept one is dropped.
    rows = _days(t).groupBy("custkey").agg(F.sort_array(F.collect_list(F.struct("day", "val")), asc=False).alias("all"))
    start = F.expr("cast(array() as array<struct<day:bigint,val:double>>)")
    kept = F.aggregate(
        "all", start, lambda acc, x: F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["day"] - x["day"] >= 300), F.concat(acc, F.array(x))).otherwise(acc)
    )
    return rows.select("custkey", F.explode(F.slice(kept, 1, 10)).alias("x")).select("custkey", F.col("x.day").alias("day"), F.col("x.val").alias("value"))


@query(
    "q40_latest_by_period",
    """select o_custkey custkey, strftime(o_orderdate, '%Y-%m') period, o_totalprice val from orders
 qualify row_number() over (partition by o_custkey, strftime(o_orderdate, '%Y-%m') order by o_orderstatus = 'P', o_orderdate desc, o_orderkey) = 1""",
)
def q40(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("period", F.date_format("o_orderdate", "yyyy-MM"))
    first = keep_first(rows, ["o_custkey", "period"], [(F.col("o_orderstatus") == "P"), F.desc("o_orderdate"), F.col("o_orderkey")])
    return first.select(F.col("o_custkey").alias("custkey"), "period", F.col("o_totalprice").alias("val"))


FLOWS = """y as (select o_custkey custkey, year(o_orderdate)::bigint as fy, sum(o_totalprice) total, sum(o_totalprice) filter (where month(o_orderdate) <= 6) half from orders group by 1, 2)"""
TTM = f"""{FLOWS}, ttm as (select c.custkey, c.fy, case when n.half is not null and c.half is not null then c.total + n.half - c.half else c.total end ttm, case when n.half is not null and c.half is not null then 'ttm' else 'annual' end as method
 from y c left join y n on n.custkey = c.custkey and n.fy = c.fy + 1)"""


def flows(t: Tables) -> DataFrame:
    """custkey, fy, total, half, ttm, method: the year, moved on by the half-years there are."""
    half = F.sum(F.when(F.month("o_orderdate") <= 6, F.col("o_totalprice")))
    y = t.orders.groupBy(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").cast("bigint").alias("fy")).agg(F.sum("o_totalprice").alias("total"), half.alias("half"))
    w = Window.partitionBy("custkey").orderBy("fy")
    following = F.when(F.lead("fy").over(w) == F.col("fy") + 1, F.lead("half").over(w))
    y = y.withColumn("following", following)
    both = F.col("following").isNotNull() & F.col("half").isNotNull()
    return y.withColumn("ttm", F.when(both, F.col("total") + F.col("following") - F.col("half")).otherwise(F.col("total"))).withColumn(
        "method", F.when(both, "ttm").otherwise("annual")
    )


@query("q41_ttm_flow", f"with {TTM} select custkey, fy, round(ttm, 4) ttm, method from ttm")
def q41(t: Tables) -> DataFrame:
    return flows(t).select("custkey", "fy", r("ttm", 4).alias("ttm"), "method")


RAMP = lambda x, a, b: f"case when ({x}) is not null then greatest(0.0, least(1.0, (({x}) - {a}) / {b - a!r})) end"


@query(
    "q42_viability",
    f"""with {FLOWS}, p as (select custkey, fy, total, total - lag(total) over (partition by custkey order by fy) d from y),
 a as (select custkey, count(*) n, avg((total > 300000)::double) pos, max(greatest(0, -d)) worst, count(d) pairs, arg_max(total, fy) last, avg(total) mean, max(fy) last_fy from p group by 1),
 s as (select *, case when n >= 3 then {RAMP('pos', 0.2, 1.0)} end cash, case when pairs >= 2 then {RAMP('last / nullif(worst, 0)', 0.25, 1.0)} end shock, {RAMP('mean / nullif(last, 0)', 1.5, 0.5)} debt from a),
 i as (select *, (case when cash is not null then 1 else 0 end + case when shock is not null then 1 else 0 end + case when debt is not null then 1 else 0 end) dims, least(coalesce(cash, 9), coalesce(shock, 9), coalesce(debt, 9)) weakest_value from s)
 select custkey, round(cash, 6) cash, round(shock, 6) shock, round(debt, 6) debt, case when dims >= 2 then round(100 * exp((coalesce(ln(greatest(cash, 0.02)), 0) * (cash is not null)::int + coalesce(ln(greatest(shock, 0.02)), 0) * (shock is not null)::int + coalesce(ln(greatest(debt, 0.02)), 0) * (debt is not null)::int) / dims), 1) end index_value,
 case when cash = weakest_value then 'cash' when shock = weakest_value then 'shock' else 'debt' end weakest, case when dims < 2 or last_fy < 2000 then 'not assessable' when weakest_value >= 0.6 then 'viable' when weakest_value >= 0.25 then 'strained' else 'at risk' end as level from i""",
)
def q42(t: Tables) -> DataFrame:
    w = Window.partitionBy("custkey").orderBy("fy")
    p = flows(t).withColumn("d", F.col("total") - F.lag("total").over(w))
    a = p.groupBy("custkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("total") > 300000).cast("double")).alias("pos"), F.max(F.greatest(F.lit(0.0), -F.col("d"))).alias("worst"),
        F.count("d").alias("pairs"), F.max_by("total", "fy").alias("last"), F.avg("total").alias("mean"), F.max("fy").alias("last_fy"),
    )
    zero = lambda c: F.nullif(F.col(c), F.lit(0.0))
    s = a.withColumn("cash", F.when(F.col("n") >= 3, ramp(F.col("pos"), 0.2, 1.0)))
    s = s.withColumn("shock", F.when(F.col("pairs") >= 2, ramp(F.col("last") / zero("worst"), 0.25, 1.0)))
    s = s.withColumn("debt", ramp(F.col("mean") / zero("last"), 1.5, 0.5))
    names = ["cash", "shock", "debt"]
    there = F.array_compact(F.array(*names))
    dims, least = F.size(there), F.array_min(there)
    mean_log = F.aggregate(there, F.lit(0.0), lambda acc, x: acc + F.log(F.greatest(x, F.lit(0.02)))) / dims
    level = F.when((dims < 2) | (F.col("last_fy") < 2000), "not assessable").when(least >= 0.6, "viable").when(least >= 0.25, "strained").otherwise("at risk")
    return s.select(
        "custkey", *[r(c).alias(c) for c in names], F.when(dims >= 2, r(100 * F.exp(mean_log), 1)).alias("index_value"),
        F.when(F.col("cash") == least, "cash").when(F.col("shock") == least, "shock").otherwise("debt").alias("weakest"), level.alias("level"),
    )


@query(
    "q45_quality_rules",
    """with z as (select event_type, event_id, value, log10(value) l from events where value > 0), m as (select *, median(l) over (partition by event_type) m from z), d as (select *, median(abs(l - m)) over (partition by event_type) mad from m)
 select 'extreme' rule, 'review' severity, event_id::varchar as key, round(value, 4) as value from d where abs(l - m) / (1.4826 * greatest(mad, 1e-9)) > 3.5
 union all select 'duplicate line', 'error', l_orderkey || '/' || l_linenumber, count(*)::double from lineitem group by l_orderkey, l_linenumber having count(*) > 2
 union all select 'ship before order', 'error', l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey, round(l_quantity, 4) from lineitem join orders on o_orderkey = l_orderkey where l_shipdate < o_orderdate - interval 2000 day
 union all select 'zero balance', 'review', c_custkey::varchar, round(c_acctbal, 4) from customer where c_acctbal <= 0
 union all select 'contradicting flags', 'review', doc_id::varchar, 1.0 from labels where quality = 1 and toxic = 1
 union all select 'impossible count', 'error', l_orderkey::varchar, count(*)::double from lineitem group by l_orderkey having count(*) > 7 * count(distinct l_suppkey)
 union all select 'outside window', 'review', event_id::varchar, round(value, 4) from events where event_type = 'signup' and ts >= timestamp '2024-01-28'
 union all select 'implausible rate', 'review', o_custkey::varchar, round(median(o_totalprice), 4) from orders group by o_custkey having median(o_totalprice) < 100000 or median(o_totalprice) > 400000 or avg((o_totalprice not between 20000 and 480000)::double) > 0.3
 union all select 'one-sided cases', 'review', l_suppkey::varchar, round(avg((l_returnflag = 'R')::double), 4) from lineitem group by l_suppkey having count(*) >= 5 and avg((l_returnflag = 'R')::double) >= 0.4
 union all select 'large on few', 'review', l_suppkey::varchar, round(sum(l_quantity), 4) from lineitem group by l_suppkey having count(distinct l_partkey) <= 100 and sum(l_quantity) >= 1000""",
)
def q45(t: Tables) -> DataFrame:
    """One pass over the lines by order, one by supplier, one joined to their orders; a row's findings are an array."""
    finding = lambda name, severity, key, value: F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    rule = lambda df, *x: df.select(F.inline(F.array(finding(*x))))
    z = t.events.where("value > 0").withColumn("l", F.log10("value"))
    mid = z.groupBy("event_type").agg(F.median("l").alias("m"))  # a row a type
    z = z.join(F.broadcast(mid), "event_type").withColumn("dev", F.abs(F.col("l") - F.col("m")))
    spread = z.groupBy(F.col("event_type").alias("_type")).agg(F.median("dev").alias("mad"))
    extreme = z.join(F.broadcast(spread), F.col("event_type") == F.col("_type")).where(F.col("dev") / (1.4826 * F.greatest(F.col("mad"), F.lit(1e-9))) > 3.5)
    orders = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"), F.size(F.collect_set("l_suppkey")).alias("k"))  # an order's lines are few
    counted = F.transform(F.array_distinct("lines"), lambda x: F.struct(x.alias("line"), F.size(F.filter("lines", lambda y: y == x)).alias("n")))
    twice = F.transform(F.filter(counted, lambda c: c["n"] > 2), lambda c: finding("duplicate line", "error", F.concat_ws("/", "l_orderkey", c["line"]), c["n"]))
    many = F.when(F.size("lines") > 7 * F.col("k"), F.array(finding("impossible count", "error", F.col("l_orderkey"), F.size("lines"))))
    found = orders.select(F.inline(F.concat(twice, F.coalesce(many, F.slice(twice, 1, 0)))))
    by_owner = t.lineitem.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"), F.countDistinct("l_partkey").alias("parts"), F.sum("l_quantity").alias("q")
    )
    owner = F.array_compact(F.array(
        F.when((F.col("n") >= 5) & (F.col("returned") >= 0.4), finding("one-sided cases", "review", F.col("l_suppkey"), r("returned", 4))),
        F.when((F.col("parts") <= 100) & (F.col("q") >= 1000), finding("large on few", "review", F.col("l_suppkey"), r("q", 4))),
    ))
    early = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate < o_orderdate - interval 2000 days")
    late = t.events.where((F.col("event_type") == "signup") & (F.col("ts") >= F.lit("2024-01-28").cast("timestamp")))
    outside = F.avg((~F.col("o_totalprice").between(20000, 480000)).cast("double"))
    rates = t.orders.groupBy("o_custkey").agg(F.median("o_totalprice").alias("m"), outside.alias("out")).where("m < 100000 or m > 400000 or out > 0.3")
    parts = [
        found, by_owner.select(F.inline(owner)), rule(extreme, "extreme", "review", F.col("event_id"), r("value", 4)),
        rule(early, "ship before order", "error", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), r("l_quantity", 4)),
        rule(t.customer.where("c_acctbal <= 0"), "zero balance", "review", F.col("c_custkey"), r("c_acctbal", 4)),
        rule(t.labels.where("quality = 1 and toxic = 1"), "contradicting flags", "review", F.col("doc_id"), F.lit(1.0)),
        rule(late, "outside window", "review", F.col("event_id"), r("value", 4)), rule(rates, "implausible rate", "review", F.col("o_custkey"), r("m", 4)),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Findings of the documents, with decisions and advice that follow from their ids.
FLAGGED = """flagged as (select doc_id, case when toxic = 1 then 'error' when quality = 0 then 'review' end severity, doc_id % 4 = 0 ranking_relevant, n_chars * 1000.0 impact, doc_id % 13 = 0 failed,
 case doc_id % 5 when 0 then 'unclear' when 1 then 'implausible' else 'plausible' end verdict, case when doc_id % 17 <> 0 then (doc_id % 11) / 10.0 end::double confidence, doc_id % 3 = 0 escalated,
 case doc_id % 7 when 0 then 'suppress' when 1 then 'correct' else 'Keep ' end as action, doc_id % 6 = 0 needs_human, case doc_id % 23 when 0 then ' Error' when 1 then 'keep' when 2 then 'suppress' when 3 then 'OK' when 4 then 'odd' end decision from documents left join labels using (doc_id))"""


def flagged(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    choice = lambda m, cases, other=None: reduce(lambda acc, kv: F.when(d % m == kv[0], kv[1]).otherwise(acc), cases.items(), F.lit(other))
    return t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left").select(
        "doc_id", F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "review").alias("severity"), (d % 4 == 0).alias("ranking_relevant"),
        (F.col("n_chars") * 1000.0).alias("impact"), (d % 13 == 0).alias("failed"), choice(5, {0: "unclear", 1: "implausible"}, "plausible").alias("verdict"),
        F.when(d % 17 != 0, (d % 11) / 10).alias("confidence"), (d % 3 == 0).alias("escalated"), choice(7, {0: "suppress", 1: "correct"}, "Keep ").alias("action"),
        (d % 6 == 0).alias("needs_human"), choice(23, {0: " Error", 1: "keep", 2: "suppress", 3: "OK", 4: "odd"}).alias("decision"),
    )


ROUTED = f"""{FLAGGED}, routed as (select *, case when failed then 'human' when verdict = 'unclear' or coalesce(confidence, 0) < 0.6 then case when escalated then 'human' else 'escalation' end
 when coalesce(severity = 'error', false) and verdict = 'plausible' then 'human' when trim(action) in ('suppress', 'correct') and (ranking_relevant or impact >= 1000000) then 'human' when needs_human and coalesce(confidence, 0) < 0.85 then 'human' else 'automatic' end route from flagged)"""


@query(
    "q46_status_resolution",
    f"""with {ROUTED} select doc_id, route, case when lower(trim(decision)) in ('error', 'suppress', 'correct') then 'error' when lower(trim(decision)) in ('ok', 'keep', 'plausible') then 'ok'
 when route = 'automatic' then case when lower(trim(action)) = 'keep' and verdict = 'plausible' then 'ok' else 'review' end else coalesce(severity, 'review') end status from routed""",
)
def q46(t: Tables) -> DataFrame:
    df = flagged(t)
    flag = {c: F.col(c) for c in ("severity", "ranking_relevant", "impact")}
    advice = {c: F.col(c) for c in ("failed", "verdict", "confidence", "escalated", "action", "needs_human")}
    df = df.withColumn("route", flags.route(flag, advice))
    return df.select("doc_id", "route", flags.status(*[F.col(c) for c in ("decision", "route", "action", "verdict", "severity")]).alias("status"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "q98_statuses_on_facts",
    """with f as (select o_custkey ticker, o_orderpriority metric, year(o_orderdate)::bigint as year, round(sum(o_totalprice), 2) as value from orders group by 1, 2, 3),
 g as (select doc_id flag_id, doc_id % 150 + 1 ticker, case when doc_id % 10 = 0 then '*' else list_extract(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], (doc_id % 5 + 1)::int) end metric, case when doc_id % 3 <> 0 then 1992 + doc_id % 7 end as year,
  case when toxic = 1 then 2 when quality = 0 then 1 else 0 end rank, 'R' || (doc_id % 4) as rule from labels),
 j as (select f.*, rank, rule, row_number() over (partition by f.ticker, f.metric, f.year order by rank desc nulls last, flag_id desc) i from f left join g on g.ticker = f.ticker and (g.metric = '*' or (g.metric = f.metric and (g.year is null or g.year = f.year))))
 select ticker, metric, year, value, case rank when 2 then 'error' when 1 then 'review' else 'ok' end quality_status, coalesce(rule, '') quality_rule, case when rule is null then '' else 'note ' || rule end quality_note from j where i = 1""",
)
def q98(t: Tables) -> DataFrame:
    facts = t.orders.groupBy(F.col("o_custkey").alias("ticker"), F.col("o_orderpriority").alias("metric"), F.year("o_orderdate").cast("bigint").alias("year")).agg(r(F.sum("o_totalprice"), 2).alias("value"))
    d = F.col("doc_id")
    metric = F.when(d % 10 == 0, "*").otherwise(F.element_at(F.array(*map(F.lit, PRIORITIES)), (d % 5 + 1).cast("int")))
    rule = F.concat(F.lit("R"), (d % 4).cast("string"))
    found = t.labels.select(
        d.alias("flag_id"), (d % 150 + 1).alias("ticker"), metric.alias("metric"), F.when(d % 3 != 0, 1992 + d % 7).alias("year"),
        F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "review").otherwise("ok").alias("status"), rule.alias("rule"), F.concat(F.lit("note "), rule).alias("note"),
    )
    return flags.apply_statuses(facts, found)


@query(
    "q47_constraint_report",
    """select 'orders unique' as constraint_name, (count(*) - count(distinct o_orderkey))::bigint violations from orders union all select 'line keys unique', (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1))
 union all select 'discount range', count(*) from lineitem where l_discount not between 0 and 0.1 union all select 'customers known', count(*) from orders where o_custkey not in (select c_custkey from customer)
 union all select 'prices finite', count(*) from part where p_retailprice is null or isinf(p_retailprice) union all select 'segments', count(*) from customer where c_mktsegment is null""",
)
def q47(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    tell = lambda df, name, c=n: df.agg(F.lit(name).alias("constraint_name"), c.cast("bigint").alias("violations"))
    price = F.col("p_retailprice")
    twice = t.lineitem.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    unknown = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    rows = [
        tell(t.orders, "orders unique", n - F.countDistinct("o_orderkey")), tell(twice, "line keys unique"),
        tell(t.lineitem.where(~F.col("l_discount").between(0, 0.1)), "discount range"), tell(unknown, "customers known"),
        tell(t.part.where(price.isNull() | (F.abs(price) == float("inf"))), "prices finite"), tell(t.customer.where("c_mktsegment is null"), "segments"),
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


#: Owner texts with parentheses in names, parts without a name, shares above one in all, misspellings and empty texts.
OWNER_RAW = """case s_suppkey % 7 when 0 then n_name || ' (US) (' || (40 + s_suppkey % 30) || '%); Beta Corp.' when 1 then '(50%); ' || n_name || ' Inc., ;' when 2 then n_name || ' Energy (80 %); ' || n_name || ' Services (40.5%)'
 when 3 then 'Beta Works; ' || n_name || '; Third Party (A)' when 4 then n_name || 'x (100%)' when 5 then ' ; , .;(25%)' else n_name || '; Beta (30%);' || n_name || ' Group (20%)' end"""
PARSED = r"""parts as (select id, i, regexp_replace(regexp_replace(x, '\(([\d.]+)\s*%\)', '', 'g'), '^[ ,.]+|[ ,.]+$', '', 'g') as name, try_cast(nullif(regexp_extract(x, '\(([\d.]+)\s*%\)', 1), '') as double) / 100 sh
  from (select id, unnest(string_split(raw, ';')) x, generate_subscripts(string_split(raw, ';'), 1) i from raws)),
 filled as (select *, coalesce(sh, greatest(0.0, 1 - sum(coalesce(sh, 0)) over (partition by id)) / count(*) filter (sh is null) over (partition by id)) s0 from parts where name <> ''),
 owners as (select id, i, name, case when sum(s0) over (partition by id) > 1.01 then s0 / sum(s0) over (partition by id) else s0 end share from filled)"""


def owner_texts(t: Tables) -> DataFrame:
    """suppkey and the raw owner text of every supplier."""
    k, n, lit = F.col("s_suppkey"), F.col("n_name"), F.lit
    texts = [
        F.concat(n, lit(" (US) ("), (40 + k % 30).cast("string"), lit("%); Beta Corp.")), F.concat(lit("(50%); "), n, lit(" Inc., ;")),
        F.concat(n, lit(" Energy (80 %); "), n, lit(" Services (40.5%)")), F.concat(lit("Beta Works; "), n, lit("; Third Party (A)")),
        F.concat(n, lit("x (100%)")), lit(" ; , .;(25%)"), F.concat(n, lit("; Beta (30%);"), n, lit(" Group (20%)")),
    ]
    named = t.supplier.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey"))
    return named.select(k.alias("suppkey"), F.element_at(F.array(*texts), (k % len(texts) + 1).cast("int")).alias("raw"))


@query("q48_parse_owners", f"with raws as (select s_suppkey id, {OWNER_RAW} raw from supplier join nation on n_nationkey = s_nationkey), {PARSED} select id suppkey, name, round(share, 6) share from owners")
def q48(t: Tables) -> DataFrame:
    return owner_texts(t).select("suppkey", F.inline(identity.parse_owners(F.col("raw")))).select("suppkey", "name", r("share").alias("share"))


NORM = lambda x: rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\([^)]*\)', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\b({'|'.join(identity.SUFFIXES)})\b', ' ', 'g'), '\s+', ' ', 'g'))"
RAW_NAME = "case when c_custkey % 9 = 0 then 'The Holdings Co.' else c_name || ' (' || (c_custkey % 7) || ' %) American Partners, Inc.' end"


@query(
    "q49_normalize_names",
    f"""with n as (select c_custkey as key, {RAW_NAME} as raw from customer), k as (select *, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') w from n)
 select key, {NORM('raw')} norm, array_to_string(case when len(list_filter(w, lambda x: x not in ({', '.join(repr(x) for x in identity.LEGAL)}))) > 0 then list_filter(w, lambda x: x not in ({', '.join(repr(x) for x in identity.LEGAL)})) else w end, ' ') tokens from k""",
)
def q49(t: Tables) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 9 == 0, "The Holdings Co.").otherwise(F.concat("c_name", F.lit(" ("), (F.col("c_custkey") % 7).cast("string"), F.lit(" %) American Partners, Inc.")))
    return t.customer.select(F.col("c_custkey").alias("key"), identity.normalize_name(raw).alias("norm"), identity.normalize_tokens(raw).alias("tokens"))


@query(
    "q99_roles_and_targets",
    r"""with r as (select s_suppkey, case s_suppkey % 4 when 0 then s_name || ' (Owner)|' || n_name || ' (Operator )' when 1 then s_name when 2 then s_name || ' (A) (Owner/Operator)| |' else 'x (' || n_name end raw,
  case s_suppkey % 3 when 0 then 'We will reduce absolute scope 1 and 2 GHG emissions ' || (s_suppkey % 120) || '% by ' || (2025 + s_suppkey % 20) || ' from a 2030 base year' when 1 then 'Reduce emissions ' || (s_suppkey % 50 + 1) || '.5 % by 2040 from a ' || (2015 + s_suppkey % 9) || ' base  year.' else n_name end said from supplier join nation on n_nationkey = s_nationkey),
 p as (select s_suppkey, trim(x) x, i from (select s_suppkey, unnest(string_split(raw, '|')) x, generate_subscripts(string_split(raw, '|'), 1) i from r) where trim(x) <> ''),
 o as (select s_suppkey, string_agg(case when regexp_matches(x, '^.*\([^(]*\)$') then trim(regexp_extract(x, '^(.*)\(([^(]*)\)$', 1)) || ':' || lower(trim(regexp_extract(x, '^(.*)\(([^(]*)\)$', 2))) else x || ':unknown' end, ';' order by i) owners from p group by 1),
 t as (select s_suppkey, try_cast(nullif(regexp_extract(said, '(?i)emissions\s+([\d.]+)\s*%\s+by\s+(\d{4})\s+from\s+a\s+(\d{4})\s+base\s*year', 1), '') as double) pct, try_cast(nullif(regexp_extract(said, '(?i)by\s+(\d{4})\s+from\s+a\s+(\d{4})', 1), '') as int) ty, try_cast(nullif(regexp_extract(said, '(?i)by\s+(\d{4})\s+from\s+a\s+(\d{4})', 2), '') as int) b from r)
 select s_suppkey suppkey, owners, case when ty > b and pct > 0 and pct < 100 then round(ln(1 - pct / 100) / (ty - b), 9) end rate, case when ty > b and pct > 0 and pct < 100 then b end base_year, case when ty > b and pct > 0 and pct < 100 then ty end target_year from t left join o using (s_suppkey)""",
)
def q99(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.col("s_name")
    raw = F.when(k % 4 == 0, F.concat(name, F.lit(" (Owner)|"), "n_name", F.lit(" (Operator )"))).when(k % 4 == 1, name).when(k % 4 == 2, F.concat(name, F.lit(" (A) (Owner/Operator)| |"))).otherwise(F.concat(F.lit("x ("), "n_name"))
    first = F.concat(F.lit("We will reduce absolute scope 1 and 2 GHG emissions "), (k % 120).cast("string"), F.lit("% by "), (2025 + k % 20).cast("string"), F.lit(" from a 2030 base year"))
    second = F.concat(F.lit("Reduce emissions "), (k % 50 + 1).cast("string"), F.lit(".5 % by 2040 from a "), (2015 + k % 9).cast("string"), F.lit(" base  year."))
    said = F.when(k % 3 == 0, first).when(k % 3 == 1, second).otherwise(F.col("n_name"))
    df = t.supplier.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey")).select(k.alias("suppkey"), identity.split_owner_operator(raw).alias("o"), identity.parse_target(said).alias("t"))
    return df.select("suppkey", F.array_join(F.transform("o", lambda x: F.concat(x["name"], F.lit(":"), x["role"])), ";").alias("owners"), r("t.rate", 9).alias("rate"), "t.base_year", "t.target_year")


#: Companies and overrides of the cascade's query, as normal forms.
COMPANIES = [("steel", "STL"), ("large ring", "LRG"), ("polished copper", "PCP")]
OVERRIDES = [("small brass", "SMB"), ("small", "SML"), ("tin", "TIN"), ("red ring", "RED")]
CASCADE_NAMES = "select p_name || case p_partkey % 4 when 0 then ' Energy' when 1 then ' Inc.' when 2 then '' else ' (50%) Works' end as name from part union all select 'Holdings Inc' union all select 'steel energy' union all select 'tinsel' union all select 'polished coper'"


@query(
    "q50_prefix_cascade",
    "with c as (select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in COMPANIES) + ") c(ckey, ticker)), o as (select * from (values " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(OVERRIDES))
    + f""") o(ordinal, okey, ticker)), n as (select distinct name, {NORM('name')} as key from ({CASCADE_NAMES})),
 m as (select name, key, (select ticker from c where ckey = key) a, (select ticker from o where okey = key) b, (select arg_min(ticker, ordinal) from o where key = okey or starts_with(key, okey || ' ')) d,
  (select ticker from c where key <> ckey and starts_with(key, ckey || ' ') and substr(key, length(ckey) + 2) in ({', '.join(repr(x) for x in identity.GENERIC_TAIL)})) e,
  case when key = 'polished coper' then 'PCP' end f from n)
 select name, key, coalesce(a, b, d, e, f) ticker, case when key = '' then 'empty' when a is not null then 'exact' when b is not null then 'override' when d is not null then 'override-prefix' when e is not null then 'parent-prefix' when f is not null then 'fuzzy' else 'unmatched' end as method,
  round(case when key = '' then 0.0 when a is not null then 1.0 when b is not null then 0.95 when d is not null then 0.9 when e is not null then 0.85 when f is not null then 28.0 / 29 else 0.0 end, 6)::double confidence from m""",
)
def q50(t: Tables) -> DataFrame:
    p = F.col("p_partkey") % 4
    names = t.part.select(F.concat("p_name", F.when(p == 0, " Energy").when(p == 1, " Inc.").when(p == 2, "").otherwise(" (50%) Works")).alias("name"))
    names = names.union(t.spark.range(1).select(F.explode(F.array(*map(F.lit, ["Holdings Inc", "steel energy", "tinsel", "polished coper"])))))
    rows = lambda items: t.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("key"), F.lit(v).alias("ticker")) for i, (k, v) in enumerate(items)])))
    found = identity.resolve(names, rows(COMPANIES), rows(OVERRIDES))
    return found.select("name", "key", "ticker", "method", r("confidence").alias("confidence"))


#: Overrides and windows of the ownership query: (key, ticker), (key, ticker, since, until).
OWNER_OVERRIDES = [("beta", "BET"), ("nation 11", "ELV")]
OWNER_RULES = [("beta", "BET", 1994, 1996), ("nation 3", "N3", None, None), ("nation 7", "N7", None, 1995), ("nation 9 energy", "N9", 1997, None)]


@query(
    "q103_ownership",
    f"""with raws as (select s_suppkey id, {OWNER_RAW} raw from supplier join nation on n_nationkey = s_nationkey), {PARSED},
 facility_years as (select distinct l_suppkey facility, year(l_shipdate)::bigint as year from lineitem),
 c as (select {NORM('n_name')} ckey, 'N' || n_nationkey ticker from nation), o as (select * from (values """ + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(OWNER_OVERRIDES)) + """) o(ordinal, okey, ticker)),
 ru as (select * from (values """ + ", ".join(f"('{k}', '{v}', {a or 'null'}, {b or 'null'})" for k, v, a, b in OWNER_RULES) + f""") ru(rkey, ticker, since, until)),
 keyed as (select distinct name, {NORM('name')} as key from owners),
 m as (select name, key, (select ticker from c where ckey = key) a, (select ticker from o where okey = key) b, (select arg_min(ticker, ordinal) from o where starts_with(key, okey || ' ')) d,
  (select ticker from c where starts_with(key, ckey || ' ') and substr(key, length(ckey) + 2) in ({', '.join(repr(x) for x in identity.GENERIC_TAIL)})) e, (select ticker from c where ckey || 'x' = key) f from keyed),
 v as (select name, key, coalesce(a, b, d, e, f) ticker, case when a is not null then 'exact' when b is not null then 'override' when d is not null then 'override-prefix' when e is not null then 'parent-prefix' else 'fuzzy' end as method,
  case when a is not null then 1.0 when b is not null then 0.95 when d is not null then 0.9 when e is not null then 0.85 else 2.0 * (length(key) - 1) / (2 * length(key) - 1) end::double conf from m where coalesce(a, b, d, e, f) is not null),
 rows as (select facility, year, i, v.ticker, share, method, conf from facility_years join owners on id = facility join v using (name) left join ru on rkey = key and ru.ticker = v.ticker
  where rkey is null or ((since is not null or until is not null) and coalesce(year >= since, true) and coalesce(year <= until, true)))
 select facility, year, ticker, round(least(sum(share), 1.0), 6) share, round(min(conf), 6) confidence, arg_min(method, i) as method from rows group by 1, 2, 3""",
)
def q103(t: Tables) -> DataFrame:
    """From raw owner texts to shares by facility, year and ticker."""
    rows = lambda items, schema: t.spark.createDataFrame(items, schema)
    years = t.lineitem.select(F.col("l_suppkey").alias("facility"), F.year("l_shipdate").cast("bigint").alias("year")).distinct()
    facilities = years.join(owner_texts(t).select(F.col("suppkey").alias("facility"), F.col("raw").alias("owner")), "facility")
    lookup = t.nation.select(identity.normalize_name(F.col("n_name")).alias("key"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker"))
    overrides = rows([(i, k, v) for i, (k, v) in enumerate(OWNER_OVERRIDES)], "ordinal int, key string, ticker string")
    found = identity.ownership(facilities, lookup, overrides, rows(OWNER_RULES, "key string, ticker string, since int, until int"))
    return found.select("facility", "year", "ticker", r("share").alias("share"), r("confidence").alias("confidence"), "method")


@query("q51_fuzzy_token_sort")
def q51(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    shuffled = names.select(F.array_join(F.reverse(F.split("name", " ")), " ").alias("name"))
    return similar.best_matches(shuffled, names, 70.0).select("name", "match", r("score", 4).alias("score"))


@query(
    "q52_text_flags",
    r"""select doc_id, len(regexp_extract_all(text, '[VS]'))::bigint n_vs, nullif(regexp_extract(text, '(\d{4})', 1), '') year_text, case when regexp_matches(lower(text), 'wood|bio') then 'Bio' when regexp_matches(lower(text), 'coal') then 'Coal' when regexp_matches(lower(text), 'gas') then 'Gas' when regexp_matches(lower(text), 'oil') then 'Oil' else 'Other' end fuel, substr(source, 1, 3) prefix from documents""",
)
def q52(t: Tables) -> DataFrame:
    low = F.lower("text")
    fuel = F.when(low.rlike("wood|bio"), "Bio").when(low.rlike("coal"), "Coal").when(low.rlike("gas"), "Gas").when(low.rlike("oil"), "Oil").otherwise("Other")
    return t.documents.select(
        "doc_id", F.regexp_count("text", F.lit("[VS]")).cast("bigint").alias("n_vs"), F.nullif(F.regexp_extract("text", r"(\d{4})", 1), F.lit("")).alias("year_text"), fuel.alias("fuel"),
        F.substring("source", 1, 3).alias("prefix"),
    )


@query("q69_html_embedded_extract", r"""select page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') title, nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') lang, regexp_extract(url, '^https?://([^/]+)', 1) host from pages""")
def q69(t: Tables) -> DataFrame:
    cut = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return t.pages.select("page_id", cut("html", "<title>([^<]*)</title>").alias("title"), cut("html", 'lang="([a-z]+)"').alias("lang"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


U = lambda *k: f"(('0x' || substr(md5(concat_ws('|', {', '.join(k)})), 1, 13))::bigint + 0.5) / 4503599627370496.0"


@query(
    "q57_bootstrap",
    f"""with d as (select rep, c_acctbal x, {U('7', 'rep', 'c_custkey')} u from customer cross join range(1, 21) g(rep)), w as (select rep, x, (u > exp(-1))::int + (u > 2 * exp(-1))::int + (u > 2.5 * exp(-1))::int + (u > (2.5 + 1.0 / 6) * exp(-1))::int + (u > (2.5 + 1.0 / 6 + 1.0 / 24) * exp(-1))::int w from d)
 select rep, round(sum(w * x) / sum(w), 4) mean from w group by 1""",
)
def q57(t: Tables) -> DataFrame:
    return stats.bootstrap_mean(t.customer, "c_custkey", "c_acctbal", 20, 7).select("rep", r("mean", 4).alias("mean"))


@query(
    "q58_permutation",
    f"""with b as (select c_custkey k, c_acctbal x, (c_mktsegment = 'BUILDING')::int s from customer), t as (select sum(x * s) sa, sum(s) na, sum(x) sx, count(*) n from b),
 o as (select rep, x, row_number() over (partition by rep order by {U('11', 'rep', 'k')}, k) as i from b cross join range(1, 51) g(rep)), p as (select rep, sum(x) ra from o, t where i <= na group by 1), d as (select ra / na - (sx - ra) / (n - na) d, sa / na - (sx - sa) / (n - na) stat from p, t)
 select round(max(stat), 4) stat, round(avg((abs(d) >= abs(stat))::double), 6) p from d""",
)
def q58(t: Tables) -> DataFrame:
    df = t.customer.select("c_custkey", "c_acctbal", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("side"))
    return stats.permutation_p(df, "c_custkey", "c_acctbal", "side", 50, 11).select(r("stat", 4).alias("stat"), r("p").alias("p"))


CUTS = "(u > exp(-1))::int + (u > 2 * exp(-1))::int + (u > 2.5 * exp(-1))::int + (u > (2.5 + 1.0 / 6) * exp(-1))::int + (u > (2.5 + 1.0 / 6 + 1.0 / 24) * exp(-1))::int"
TOTALS = "select o_custkey k, round(sum(o_totalprice), 6) x, max(o_totalprice) y from orders group by 1"


@query(
    "q107_bootstrap_spearman",
    f"""with b as ({TOTALS}), d as (select rep, x, y, {U('17', 'rep', 'k')} u from b cross join range(1, 501) g(rep)), w as (select * from (select rep, x, y, {CUTS} w from d) where w > 0),
 k as (select rep, w, sum(w) over (partition by rep order by x) - (sum(w) over (partition by rep, x) - 1) / 2.0 a, sum(w) over (partition by rep order by y) - (sum(w) over (partition by rep, y) - 1) / 2.0 b from w),
 s as (select rep, sum(w) n, (sum(w * a * b) - sum(w * a) * sum(w * b) / sum(w)) / sqrt((sum(w * a * a) - sum(w * a) ** 2 / sum(w)) * (sum(w * b * b) - sum(w * b) ** 2 / sum(w))) rho from k group by 1)
 select count(*) replicates, round(quantile_cont(rho, 0.025), 6) low, round(median(rho), 6) mid, round(quantile_cont(rho, 0.975), 6) high from s where n > 20""",
)
def q107(t: Tables) -> DataFrame:
    """The 95 % interval of Spearman's rho of a customer's total and largest order, from 500 replicates."""
    rows = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(r(F.sum("o_totalprice")).alias("x"), F.max("o_totalprice").alias("y"))
    rho = stats.bootstrap_spearman(rows, "k", "x", "y", 500, 17).where("rho is not null")
    q = F.percentile("rho", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return rho.agg(F.count(F.lit(1)).alias("replicates"), q.alias("q")).select("replicates", *[r(F.element_at("q", i + 1)).alias(n) for i, n in enumerate(("low", "mid", "high"))])


@query(
    "q108_permutation_median",
    f"""with b as (select c_custkey k, c_acctbal x, c_mktsegment = 'BUILDING' s from customer), t as (select count(*) filter (s) n1, count(*) n, median(x) filter (s) - median(x) filter (not s) d from b),
 o as (select rep, x, row_number() over (partition by rep order by {U('13', 'rep', 'k')}, k) as i from b cross join range(1, 1001) g(rep)), p as (select rep, median(x) filter (i <= n1) - median(x) filter (i > n1) d from o, t group by 1)
 select round(t.d, 4) diff, round((select avg((round(abs(p.d), 9) >= round(abs(t.d), 9))::double) from p), 6) p, n1, n - n1 n0 from t""",
)
def q108(t: Tables) -> DataFrame:
    """Whether one segment's median balance differs, by 1000 relabellings."""
    df = t.customer.select("c_custkey", "c_acctbal", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("side"))
    return stats.permutation_median(df, "c_custkey", "c_acctbal", "side", 1000, 13).select(r("diff", 4).alias("diff"), r("p").alias("p"), "n1", "n0")


GATE_STEP = """select metric, m + 1, a, b, x, front, mirrored, c3, d3, h * d2 * c2 * d3 * c3 from (select *, 1 / (1 + odd * d2) d3, 1 + odd / c2 c3 from (select *, 1 / (1 + even * d) d2, 1 + even / c c2 from (
  select *, m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m)) even, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m)) odd from f where m <= 60)))"""


@query(
    "q109_correlation_gate",
    f"""with recursive w as (select c_custkey k, case when c_acctbal > 0 then c_acctbal end balance, sum(o_totalprice) spend, nullif(count(o_orderkey), 0)::double orders, max(o_totalprice) largest, min(o_totalprice) smallest, max(case when o_orderpriority = '1-URGENT' then o_totalprice end) urgent,
   case when c_custkey % 100 = 3 then c_acctbal end rare from customer left join orders on o_custkey = c_custkey group by c_custkey, c_acctbal),
 l as (select k, unnest(['balance', 'spend', 'orders', 'largest', 'smallest', 'urgent', 'rare']) metric, unnest([balance, spend, orders, largest, smallest, urgent, rare]) v from w), names as (select distinct metric from l where v is not null),
 p as (select l.metric, l.v, ref.v rv from l join l ref on ref.k = l.k and ref.metric = 'spend' and ref.v is not null where l.v is not null),
 k as (select metric, rank() over (partition by metric order by v) + (count(*) over (partition by metric, v) - 1) / 2.0 a, rank() over (partition by metric order by rv) + (count(*) over (partition by metric, rv) - 1) / 2.0 b from p),
 s as (select names.metric, count(a) n, case when names.metric = 'spend' then 1.0 when count(a) >= 20 then corr(a, b) end rho from names left join k using (metric) group by 1),
 z as (select metric, (n - 2) / 2.0 a0, 0.5 b0, (n - 2) / (n - 2 + rho * rho * (n - 2) / ((1 - rho) * (1 + rho))) x0 from s where rho is not null and abs(rho) < 1),
 y as (select *, x0 >= (a0 + 1) / (a0 + b0 + 2) mirrored, exp(lgamma(a0 + b0) - lgamma(a0) - lgamma(b0) + a0 * ln(x0) + b0 * ln(1 - x0)) front from z),
 g as (select metric, case when mirrored then b0 else a0 end::double a, case when mirrored then a0 else b0 end::double b, case when mirrored then 1 - x0 else x0 end x, front, mirrored from y),
 f as (select metric, 1 m, a, b, x, front, mirrored, 1.0::double c, 1 / (1 - (a + b) * x / (a + 1)) d, 1 / (1 - (a + b) * x / (a + 1)) h from g union all {GATE_STEP}),
 e as (select metric, case when mirrored then 1 - front * h / a else front * h / a end p from f where m = 61)
 select metric, n, round(rho, 6) rho, round(case when metric = 'spend' or abs(rho) >= 1 then 0.0 else p end, 6) p, case when metric = 'spend' then 'reference' when abs(rho) > 0.3 then 'side axis' else 'ok' end gate from s left join e using (metric)""",
)
def q109(t: Tables) -> DataFrame:
    """Every metric of a customer against what the customer spent."""
    price = F.col("o_totalprice")
    w = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "c_acctbal").agg(
        r(F.sum(price)).alias("spend"), F.nullif(F.count("o_orderkey"), F.lit(0)).cast("double").alias("orders"), F.max(price).alias("largest"), F.min(price).alias("smallest"),
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", price)).alias("urgent"),
    )
    bal = F.col("c_acctbal")
    w = w.withColumn("balance", F.when(bal > 0, bal)).withColumn("rare", F.when(F.col("c_custkey") % 100 == 3, bal)).withColumnRenamed("c_custkey", "key")
    long = w.unpivot(["key"], ["balance", "spend", "orders", "largest", "smallest", "urgent", "rare"], "metric", "value")
    return stats.correlation_gate(long, "spend").select("metric", "n", r("rho").alias("rho"), r("p").alias("p"), "gate")


@query(
    "q59_mann_whitney",
    """with b as (select round(o_totalprice, -2) x, (o_orderpriority like '1%')::int a from orders), c as (select x, sum(a)::double a, count(*)::double n from b group by 1), k as (select *, coalesce(sum(n) over (order by x rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2 rk from c),
 s as (select sum(a * rk) r, sum(a) na, sum(n) n, sum(n * n * n - n) ties from k), u as (select *, r - na * (na + 1) / 2 u, n - na nb from s)
 select round(u, 2) u, round((u - na * nb / 2) / sqrt(na * nb / 12 * (n + 1 - ties / (n * (n - 1)))), 6) z from u""",
)
def q59(t: Tables) -> DataFrame:
    df = t.orders.select(F.round("o_totalprice", -2).alias("x"), F.col("o_orderpriority").startswith("1").cast("int").alias("a"))
    return stats.mann_whitney(df, "x", "a").select(r("u", 2).alias("u"), r("z").alias("z"))


@query("q60_peer_kmeans")
def q60(t: Tables) -> DataFrame:
    return stats.peer_groups(t.embeddings, "vec_id", "embedding", 9, 8).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query("q61_pca_weights")
def q61(t: Tables) -> DataFrame:
    return stats.principal_weights(t.embeddings, "embedding").select("dim", r("weight").alias("weight"))


@query("q62_portfolio_qp")
def q62(t: Tables) -> DataFrame:
    """Weights of all issuers with revenue."""
    rows = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("cap"), (F.sum("l_quantity") / F.sum("l_extendedprice")).alias("carbon"))
    named = rows.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey"))
    whole = named.agg(F.sum("cap"), F.max("cap"), F.count("carbon")).first()
    if not whole[2]:
        return t.spark.createDataFrame([], "key bigint, benchmark double, weight double")
    ranked = ranking.average_ranks(named.select("l_suppkey", "cap", "carbon", F.col("n_regionkey").alias("group")), ["carbon"])
    carbon = F.pow(F.greatest(F.lit(0.0), F.col("carbon") / F.lit(float(whole[2])) - 0.2), 2)
    issuers = ranked.select("l_suppkey", (F.col("cap") / F.lit(float(whole[0]))).alias("benchmark"), carbon.alias("carbon"), "group")
    df = stats.low_carbon_portfolio(issuers, max(0.06, 5 * float(whole[1]) / float(whole[0])))
    return df.select(F.col("l_suppkey").cast("bigint").alias("key"), r("benchmark", 12).alias("benchmark"), r("weight", 12).alias("weight"))


@query(
    "q88_applicability_ledger",
    "with u as (select user_id, " + ", ".join(f"max(value) filter (where event_type = '{k}') {k}" for k in KINDS) + " from events group by 1), l as (" + " union all ".join(f"select user_id, '{k}' metric, {k} v, view vw from u" for k in KINDS)
    + """) select user_id, metric, case when v > 20 then 'disclosed' when v is not null then 'not computable' when metric = 'error' then 'not applicable' when vw is not null then 'withheld' else 'not expected' end status from l""",
)
def q88(t: Tables) -> DataFrame:
    wide = t.events.groupBy("user_id").pivot("event_type", KINDS).agg(F.max("value"))
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("v")) for k in KINDS])
    long = wide.select("user_id", F.col("view").alias("vw"), F.inline(rows))
    status = F.when(F.col("v") > 20, "disclosed").when(F.col("v").isNotNull(), "not computable").when(F.col("metric") == "error", "not applicable").when(F.col("vw").isNotNull(), "withheld").otherwise("not expected")
    return long.select("user_id", "metric", status.alias("status"))


@query(
    "q89_series_and_due",
    """with p as (select o_custkey custkey, o_orderdate::date as d, o_totalprice v, lag(o_orderdate::date) over w pd, lag(o_totalprice) over w pv from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
 select custkey, count(*) n, count(*) filter (where datediff('day', pd, d) between 30 and 400) pairs, round(max(pv - v) filter (where datediff('day', pd, d) between 30 and 400), 4) worst_drop, round(sum(v) filter (where d >= date '2000-01-01'), 4) due from p group by 1""",
)
def q89(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = t.orders.withColumn("gap", F.datediff("o_orderdate", F.lag("o_orderdate").over(w))).withColumn("drop", F.lag("o_totalprice").over(w) - F.col("o_totalprice"))
    ok = F.col("gap").between(30, 400)
    return p.groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("pairs"), r(F.max(F.when(ok, F.col("drop"))), 4).alias("worst_drop"),
        r(F.sum(F.when(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp"), F.col("o_totalprice"))), 4).alias("due"),
    )


@query(
    "q90_repair_checks",
    """select 'no negative price' topic, count(*) filter (where o_totalprice < 0) = 0 resolved from orders union all select 'every nation has a region', count(*) filter (where r_regionkey is null) = 0 from nation left join region on r_regionkey = n_regionkey
 union all select 'one row a document', count(*) = count(distinct doc_id) from documents union all select 'line keys unique', count(*) = count(distinct (l_orderkey, l_linenumber)) from lineitem""",
)
def q90(t: Tables) -> DataFrame:
    tell = lambda df, topic, ok: df.agg(F.lit(topic).alias("topic"), ok.alias("resolved"))
    n = F.count(F.lit(1))
    regions = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return (
        tell(t.orders, "no negative price", F.count_if(F.col("o_totalprice") < 0) == 0)
        .unionByName(tell(regions, "every nation has a region", F.count_if(F.col("r_regionkey").isNull()) == 0))
        .unionByName(tell(t.documents.select("doc_id"), "one row a document", n == F.countDistinct("doc_id")))
        .unionByName(tell(t.lineitem, "line keys unique", n == F.countDistinct("l_orderkey", "l_linenumber")))
    )


@query(
    "q92_levers_credibility",
    """with b as (select c_custkey k, c_mktsegment sector, case when c_acctbal > 0 then c_acctbal end v from customer), q as (select *, quantile_cont(v, 0.333) over (partition by sector) lo, quantile_cont(v, 0.667) over (partition by sector) hi, count(v) over (partition by sector) n from b),
 g as (select user_id k, count(distinct event_type) kinds, max(value) top, min(value) bottom from events group by 1)
 select q.k as key, case when n < 5 or v is null then 'no peers' when v >= hi then 'already' else printf('%+.1f%%', round(100 * (hi / v - 1), 1)) end lever, case when v >= hi then 'top' when v >= lo then 'middle' when v is not null then 'bottom' end tercile,
 coalesce(concat_ws('; ', case when kinds < 3 then 'few kinds' end, case when top > 150 then 'high peak' end, case when bottom < 0.5 then 'near zero' end), '') flags,
 case when kinds is null then 'none' when (kinds < 3)::int + (top > 150)::int + (bottom < 0.5)::int = 0 then 'credible' when (kinds < 3)::int + (top > 150)::int + (bottom < 0.5)::int <= 2 then 'some doubt' else 'doubtful' end credibility from q left join g using (k)""",
)
def q92(t: Tables) -> DataFrame:
    """What a tercile of the peers asks for, and which flags speak against a series."""
    v = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    b = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("sector"), v.alias("v"))
    bounds = b.groupBy("sector").agg(F.percentile("v", F.lit(0.333)).alias("lo"), F.percentile("v", F.lit(0.667)).alias("hi"), F.count("v").alias("n"))
    b = b.join(F.broadcast(bounds), "sector", "left").select("key", "v", "lo", "hi", "n")  # a row a sector
    g = t.events.groupBy(F.col("user_id").alias("key")).agg(F.countDistinct("event_type").alias("kinds"), F.max("value").alias("top"), F.min("value").alias("bottom"))
    change = F.format_string("%+.1f%%", F.round(100 * (F.col("hi") / F.col("v") - 1), 1))
    flags = F.array_compact(F.array(F.when(F.col("kinds") < 3, "few kinds"), F.when(F.col("top") > 150, "high peak"), F.when(F.col("bottom") < 0.5, "near zero")))
    said = F.size(flags)
    return b.join(g, "key", "left").select(
        "key", F.when((F.col("n") < 5) | F.col("v").isNull(), "no peers").when(F.col("v") >= F.col("hi"), "already").otherwise(change).alias("lever"),
        F.when(F.col("v") >= F.col("hi"), "top").when(F.col("v") >= F.col("lo"), "middle").when(F.col("v").isNotNull(), "bottom").alias("tercile"),
        F.array_join(flags, "; ").alias("flags"),
        F.when(F.col("kinds").isNull(), "none").when(said == 0, "credible").when(said <= 2, "some doubt").otherwise("doubtful").alias("credibility"),
    )
