"""Filings: flows of trailing years, annual series and viability, over facts that follow from the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import filings
from ledgerline.sources.shared import stored

from .base import Tables, query, r

#: Facts from a company's years: tag, start, end, value, form, days until filed, condition.  c is the company, y the year, j, m and d
#: the numbers of its first of January, thirtieth of June and last of December.  Both engines read these as they are.
SPECS = [
    ("case when c % 3 <> 0 then 'Ocf' else 'OcfContinuing' end", "j", "d", "tot * sign - 100000", "10-K", "60", "y < 1998 and c % 29 <> 5"),
    ("case when c % 3 <> 0 then 'Ocf' else 'OcfContinuing' end", "j", "d", "0", "8-K", "400", "y < 1998 and c % 4 = 0 and c % 29 <> 5"),
    ("case when c % 3 <> 0 then 'Ocf' else 'OcfContinuing' end", "j", "d", "tot * sign - 90000", "10-K", "425", "y < 1997 and c % 5 = 0 and c % 29 <> 5"),
    ("case when c % 3 <> 0 then 'Ocf' else 'OcfContinuing' end", "j", "m", "half - 50000", "10-Q", "40", "half is not null and c % 10 <> 9"),
    ("'Ocf'", "m + 1", "d + 181", "999", "10-Q", "30", "c % 7 = 0"),
    ("'OcfContinuing'", "j", "d", "tot * 0.5", "10-K", "61", "y < 1996 and c % 2 = 0 and c % 29 <> 5"),
    ("'Ocf'", "j + 90", "d + 90", "12345", "10-K", "60", "y = 1995 and c % 11 = 0 and c % 29 <> 5"),
    ("'Assets'", "null", "d", "tot * 2 + 1000", "10-K", "60", "y < 1998 and c % 17 <> 1"),
    ("'Assets'", "null", "d", "tot * 2 + 2000", "10-K", "420", "y < 1997 and c % 2 = 0 and c % 17 <> 1"),
    ("'IfrsAssets'", "null", "d", "tot * 2 + 500", "10-K", "60", "y < 1998 and c % 17 = 1"),
    ("'ShortInvestments'", "null", "d", "tot * 0.12", "10-K", "60", "y < 1998 and c % 5 < 2"),
    ("'Cash'", "null", "d", "tot * 0.3", "10-K", "60", "y < 1998 and c % 8 <> 3"),
    ("'DebtCurrent'", "null", "d", "tot * 0.4", "10-K", "60", "y < 1998 and c % 3 = 0"),
    ("'LongTermDebtCurrent'", "null", "d", "tot * 0.2", "10-K", "60", "y < 1998 and c % 3 = 1"),
    ("'ShortTermBorrowings'", "null", "d", "tot * 0.05", "10-K", "60", "y < 1998 and c % 2 = 0"),
    ("'NextTwelveMonths'", "null", "d - 90", "tot * 0.1", "10-K", "60", "y < 1998 and c % 6 = 2"),
    ("'Depreciation'", "j", "d", "tot * 0.15", "10-K", "60", "y < 1998 and c % 9 <> 0"),
    ("'InterestPaid'", "j", "d", "tot * 0.1", "10-K", "60", "y < 1998 and c % 4 <> 1"),
    ("'Revenue'", "j", "d", "tot * 1000", "10-K", "60", "y < 1998 and c % 6 <> 0"),
    ("'OperatingIncome'", "j", "d", "tot * 200", "10-K", "60", "y < 1998 and c % 6 <> 1"),
    ("'Costs'", "j", "d", "tot * 0.7", "10-K", "60", "y < 1998 and c % 4 = 0"),
    ("'Labor'", "j", "d", "tot * 300000", "10-K", "60", "y < 1998 and c % 10 = 0"),
]
OCF = ["Ocf", "OcfContinuing"]
#: Early years of every thirteenth company stand under a predecessor's number.
MOVED = "case when c % 13 = 0 and y < 1994 then c + 1000000 else c end"
FACTS = """days as (select o_custkey c, year(o_orderdate)::bigint as y, round(sum(o_totalprice), 2) tot, round(sum(o_totalprice) filter (where month(o_orderdate) <= 6), 2) half from orders group by 1, 2),
 yrs as (select *, case when (c + y) % 4 = 0 then -1 else 1 end sign, datediff('day', date '1970-01-01', make_date(y, 1, 1)) j, datediff('day', date '1970-01-01', make_date(y, 6, 30)) m, datediff('day', date '1970-01-01', make_date(y, 12, 31)) d from days),
 facts as (""" + " union all ".join(
    f"select c cik, {tag} tag, ({start})::bigint s, ({end})::bigint e, ({val})::double val, '{form}' form, ({end})::bigint + {filed} filed from yrs where {cond}" for tag, start, end, val, form, filed, cond in SPECS
) + """), best as (select *, e - s n from facts where s is not null qualify row_number() over (partition by cik, tag, s, e order by val = 0, filed desc, form, val) = 1),
 ann as (select * from best where n between 350 and 380 and form not like '10-Q%'), part as (select * from best where n between 80 and 300)"""
FLOWS = f"""{FACTS}, yr as (select * from ann qualify row_number() over (partition by cik, tag order by e desc, s desc) = 1), nw as (select cik, tag, max(e) newest from part group by 1, 2),
 k as (select coalesce(yr.cik, nw.cik) cik, coalesce(yr.tag, nw.tag) tag, yr.val, yr.e ye, newest, yr.e is not null and coalesce(newest - yr.e <= 400, true) usable from yr full join nw on nw.cik = yr.cik and nw.tag = yr.tag),
 pr as (select k.cik, k.tag, arg_max(a.val, a.e * 100000 + a.s) prior from k join ann a on a.cik = k.cik and a.tag = k.tag and k.ye - a.e between 350 and 380 group by 1, 2),
 yt as (select k.cik, k.tag, max(struct_pack(n := n, val := p.val)) ytd from k join part p on p.cik = k.cik and p.tag = k.tag and p.e = newest group by 1, 2),
 cu as (select k.cik, k.tag, max(struct_pack(e := p.e, n := n, val := p.val)) cur from k join part p on p.cik = k.cik and p.tag = k.tag and p.e > ye and abs(p.s - ye - 1) <= 7 where usable group by 1, 2),
 co as (select cu.cik, cu.tag, min(struct_pack(off := abs(cur.e - b.e - 365), s := b.s, val := b.val)).val comparable from cu join best b on b.cik = cu.cik and b.tag = cu.tag and abs(cur.e - b.e - 365) <= 10 and abs(b.n - cur.n) <= 10 group by 1, 2),
 flows as (select cik, tag, case when usable then val end fy, case when usable then ye end fy_end, case when usable then prior end prior_fy, case when not usable then ytd.val * 365 / ytd.n when comparable is not null then val + cur.val - comparable else val end ttm,
  case when not usable then newest when comparable is not null then cur.e else ye end ttm_end, case when not usable then 'annualised YTD' when comparable is not null then 'FY + YTD' else 'fiscal year' end as method
  from k left join pr using (cik, tag) left join yt using (cik, tag) left join cu using (cik, tag) left join co using (cik, tag) where usable or ytd is not null),
 bf as (select * from flows where tag in ('Ocf', 'OcfContinuing') qualify row_number() over (partition by cik order by ttm_end desc, method <> 'annualised YTD' desc, coalesce(fy_end, -1000000) desc, tag = 'Ocf' desc) = 1)"""


def facts(t: Tables) -> DataFrame:
    """The facts as filed: early years of some companies under their predecessors' numbers."""
    month, price = F.month("o_orderdate"), F.col("o_totalprice")
    days = t.orders.groupBy(F.col("o_custkey").alias("c"), F.year("o_orderdate").cast("bigint").alias("y")).agg(r(F.sum(price), 2).alias("tot"), r(F.sum(F.when(month <= 6, price)), 2).alias("half"))
    on = lambda m, d: F.unix_date(F.make_date(F.col("y").cast("int"), F.lit(m), F.lit(d))).cast("bigint")
    yrs = days.withColumns({"sign": F.when((F.col("c") + F.col("y")) % 4 == 0, -1).otherwise(1), "j": on(1, 1), "m": on(6, 30), "d": on(12, 31)})
    spec = [
        F.when(F.expr(cond), F.struct(F.expr(tag).alias("tag"), F.expr(f"cast({start} as bigint)").alias("start"), F.expr(f"cast({end} as bigint)").alias("end"), F.expr(f"cast({val} as double)").alias("val"), F.lit(form).alias("form"), F.expr(f"cast({end} as bigint) + {filed}").alias("filed")))
        for tag, start, end, val, form, filed, cond in SPECS
    ]
    return yrs.select(F.expr(MOVED).alias("cik"), F.inline(F.array_compact(F.array(*spec))))


def merged(t: Tables) -> DataFrame:
    was = t.customer.where("c_custkey % 13 = 0").select((F.col("c_custkey") + 1_000_000).alias("predecessor"), F.col("c_custkey").alias("cik"))
    return filings.merge_predecessors(facts(t), was)


@query("q100_filing_flows", f"with {FLOWS} select cik, tag, round(fy, 4) fy, fy_end, round(prior_fy, 4) prior_fy, round(ttm, 4) ttm, ttm_end, method, bf.cik is not null best from flows left join bf using (cik, tag) where tag in ('Ocf', 'OcfContinuing', 'Depreciation')".replace("bf.cik is not null best", "exists (select 1 from bf where bf.cik = flows.cik and bf.tag = flows.tag) best").replace(" left join bf using (cik, tag)", ""))
def q100(t: Tables) -> DataFrame:
    found = filings.flows(merged(t).where(F.col("tag").isin(*OCF, "Depreciation")))
    best = filings.best_flow(found, OCF).select(F.col("cik").alias("_cik"), F.col("tag").alias("_tag"))
    df = found.join(best, (F.col("cik") == F.col("_cik")) & (F.col("tag") == F.col("_tag")), "left")
    return df.select("cik", "tag", r("fy", 4).alias("fy"), "fy_end", r("prior_fy", 4).alias("prior_fy"), r("ttm", 4).alias("ttm"), "ttm_end", "method", F.col("_cik").isNotNull().alias("best"))


SERIES = """ser as (select cik, e, val from ann where tag in ('Ocf', 'OcfContinuing') qualify row_number() over (partition by cik, e order by tag = 'Ocf' desc, s desc) = 1),
 kept as (select cik, e, val from (select *, lead(e) over (partition by cik order by e) next from ser) where next is null or next - e >= 300),
 hist as (select * from kept qualify row_number() over (partition by cik order by e desc) <= 10),
 ast as (select cik, e, val base from facts where tag in ('Assets', 'IfrsAssets') qualify row_number() over (partition by cik, e order by filed desc) = 1),
 pairs as (select h.cik, h.e, greatest(lag(h.val) over w - h.val, 0) fall, h.e - lag(h.e) over w gap, lag(h.e) over w pe from hist h window w as (partition by h.cik order by h.e)),
 wor as (select p.cik, count(*) pairs, max(fall / base) share, arg_max(p.e, fall / base * 1e12 - p.e / 1e6) worst_end from pairs p join ast a on a.cik = p.cik and a.e = p.pe where base > 0 and gap between 330 and 400 group by 1)"""


@query(
    "q101_annual_series",
    f"with {FACTS}, {SERIES} select h.cik, h.e as fiscal_end, round(h.val, 4) as value, coalesce(pairs, 0) pairs, round(share, 6) worst_share from hist h left join wor using (cik)",
)
def q101(t: Tables) -> DataFrame:
    all_ = merged(t)
    series = filings.annual_series(all_, OCF)
    assets = filings.instant_maps(all_, ["Assets", "IfrsAssets"]).select("cik", filings.first_there([F.col("Assets"), F.col("IfrsAssets")]).alias("assets"))
    df = series.join(assets, "cik", "left").withColumn("w", filings.worst_shortfall(F.col("series"), F.coalesce("assets", F.expr("cast(map() as map<bigint,double>)"))))
    return df.select("cik", "w", F.inline("series")).select("cik", F.col("end").alias("fiscal_end"), r("val", 4).alias("value"), F.col("w.pairs").cast("bigint").alias("pairs"), r("w.share").alias("worst_share"))


def ramp_sql(x: str, a: float, b: float) -> str:
    return f"case when ({x}) is not null then greatest(0.0, least(1.0, (({x}) - {a}) / {b - a!r})) end"


def at_sql(tag: str) -> str:
    return f"(select val from facts x where x.cik = mem.cik and x.tag = '{tag}' and x.e = mem.bs_end order by filed desc limit 1)"


def ttm_sql(tag: str) -> str:
    return f"(select ttm from flows y where y.cik = mem.cik and y.tag = '{tag}')"


def shown_sql(x: str) -> str:
    return f"case when excluded is null then {x} end"


@query(
    "q102_filing_viability",
    f"""with {FLOWS}, {SERIES}, dh as (select cik, e, val from ann where tag = 'Depreciation' qualify row_number() over (partition by cik, e order by s desc) = 1),
 mem as (select c_custkey cik, c_mktsegment sector, (select max(e) from ast where ast.cik = c_custkey) bs_end, exists (select 1 from facts where facts.cik = c_custkey) filed from customer),
 hs as (select h.cik, count(*) n, count(*) filter (where h.val > 0) pos, max(h.e) last_fy, count(dh.e) paired, count(*) filter (where dh.e is not null and h.val >= dh.val) covered from hist h left join dh on dh.cik = h.cik and dh.e = h.e group by 1),
 rc as (select cik, min(val) least from (select * from hist qualify row_number() over (partition by cik order by e desc) <= 3) group by 1),
 inp as (select mem.cik, sector, n, pos, last_fy, paired, covered, least, pairs, share, bf.ttm ocf, ip.ttm interest, {at_sql('Cash')} + coalesce({at_sql('ShortInvestments')}, 0) cash, coalesce({at_sql('Assets')}, {at_sql('IfrsAssets')}) assets_now, worst_end, filed, {ttm_sql('Revenue')} revenue, {ttm_sql('OperatingIncome')} operating, {ttm_sql('Costs')} costs, {ttm_sql('Depreciation')} dep, {ttm_sql('Labor')} labor,
  coalesce({at_sql('DebtCurrent')}, case when coalesce({at_sql('LongTermDebtCurrent')}, {at_sql('ShortTermBorrowings')}, sch.val) is not null then coalesce({at_sql('LongTermDebtCurrent')}, sch.val, 0) + coalesce({at_sql('ShortTermBorrowings')}, 0) end) due
  from mem left join hs using (cik) left join rc using (cik) left join wor using (cik) left join bf using (cik) left join (select * from flows where tag = 'InterestPaid') ip using (cik)
  left join (select m2.cik, arg_max(f.val, f.e) val from facts f join mem m2 on m2.cik = f.cik where f.tag = 'NextTwelveMonths' and m2.bs_end - f.e between 0 and 400 group by 1) sch using (cik)),
 d1 as (select *, case when n >= 3 then {ramp_sql('pos::double / n', 0.5, 1.0)} end g1, case when paired >= 3 then {ramp_sql('covered::double / paired', 0.5, 0.9)} end g2, case when ocf <= 0 then 0.0 when ocf > 0 then case when coalesce(least > 0, true) then 1.0 else 0.5 end end g3,
  case when pairs >= 2 then ocf - share * assets_now end shock, case when ocf + abs(interest) > 0 then abs(interest) / (ocf + abs(interest)) when ocf + abs(interest) <= 0 then 1.0 end ishare,
  case when cash + greatest(coalesce(ocf, 0), 0) > 0 then due / (cash + greatest(coalesce(ocf, 0), 0)) when cash is not null then case when due = 0 then 0.0 when due is not null then 'inf'::double end end ratio from inp),
 d2 as (select *, list_avg(list_filter([g1, g2, g3], lambda x: x is not null)) cg, case when shock >= 0 then 1.0 when shock < 0 then {ramp_sql('cash / -shock', 0.25, 1.0)} end sa,
  list_avg(list_filter([{ramp_sql('ishare', 0.5, 0.1)}, {ramp_sql('case when ratio is not null then least(ratio, 10.0) end', 1.5, 0.5)}], lambda x: x is not null)) ds from d1),
 d3 as (select *, list_filter([cg, sa, ds], lambda x: x is not null) there from d2), d4 as (select *, list_min(there) low, case when not filed then 'no SEC data' when sector = 'BUILDING' or last_fy is null then 'not assessable' when last_fy < 9800 then 'no recent filings' end excluded,
  case when not filed then '' when sector = 'BUILDING' then 'sector excluded by this model' when last_fy is null then 'no fiscal-year history yet' else '' end note, coalesce(revenue - operating, costs) - coalesce(dep, 0) spent,
  list_filter(['cash_generation', 'shock_absorption', 'debt_service'], lambda x, k: [cg, sa, ds][k] is null) gone from d3),
 d5 as (select cik, excluded, note, there, low, gone, spent, n, pos, ratio, labor, case when excluded is null then cg end cg, case when excluded is null then sa end sa, case when excluded is null then ds end ds, paired, covered, g3, share, worst_end, ocf, shock, cash, ishare, due from d4)
 select cik, round(cg, 6) cash_generation, round(sa, 6) shock_absorption, round(ds, 6) debt_service, case when excluded is null and len(there) >= 2 then round(round(100 * exp(list_avg(list_transform(there, lambda x: ln(greatest(x, 0.02))))), 6), 1) end index_value,
  case when excluded is null and len(there) >= 2 then case when cg = low then 'cash_generation' when sa = low then 'shock_absorption' else 'debt_service' end end weakest,
  coalesce(excluded, case when len(there) < 2 then 'not assessable' when low >= 0.6 then 'viable' when low >= 0.25 then 'strained' else 'at risk' end) as level, case when excluded is null then coalesce(pos, 0) || '/' || coalesce(n, 0) end record, case when excluded is null then ratio = 'inf'::double end unpayable,
  case when excluded is null and paired > 0 then covered || '/' || paired end covers, case when excluded is null then case g3 when 1.0 then 'yes' when 0.5 then 'partly' when 0.0 then 'no' end end positive_now, {shown_sql('round(100 * share, 1)')} worst_pct, {shown_sql('worst_end')} worst_end,
  {shown_sql('round(ocf / 1e9, 2)')} ocf_bn, {shown_sql('round(shock / 1e9, 2)')} shock_bn, {shown_sql('round(cash / 1e9, 2)')} cash_bn, {shown_sql('round(case when shock < 0 then cash / -shock end, 2)')} coverage, {shown_sql('round(100 * ishare, 1)')} interest_pct, {shown_sql('round(due / 1e9, 2)')} due_bn,
  {shown_sql('round(case when spent > 0 then cash / (spent / 12) end, 1)')} cash_months, {shown_sql('round(labor / 1e9, 2)')} labor_bn,
  case when excluded is null then array_to_string(list_filter([case when coalesce(n, 0) < 3 then 'only ' || coalesce(n, 0) || ' fiscal year(s) of history' end, case when len(there) >= 2 and len(gone) > 0 then 'missing: ' || array_to_string(gone, ', ') end], lambda x: x is not null), '; ') else note end notes from d5""",
)
def q102(t: Tables) -> DataFrame:
    """Every member with the row that its filings give; a stated sector is excluded, and so are members without years or with old ones.

    The facts are built once and dealt by company; whatever is grouped or joined after that is a company's, so it stays where it is."""
    all_ = stored(merged(t), "facts").repartition("cik")
    flows = {"ocf": OCF, "interest": ["InterestPaid"], "revenue": ["Revenue"], "operating": ["OperatingIncome"], "costs": ["Costs"], "depreciation": ["Depreciation"], "labor": ["Labor"]}
    best = filings.best_flows(filings.flows(all_.where(F.col("tag").isin(*[x for tags in flows.values() for x in tags]))), flows, ("revenue",))
    series = filings.annual_series(all_, OCF)
    dna = filings.annual_series(all_, ["Depreciation"]).withColumnRenamed("series", "dna")
    tags = ["Assets", "IfrsAssets", "Cash", "ShortInvestments", "DebtCurrent", "LongTermDebtCurrent", "ShortTermBorrowings", "NextTwelveMonths"]
    maps = filings.instant_maps(all_, tags).withColumn("assets", filings.first_there([F.col("Assets"), F.col("IfrsAssets")]))
    maps = maps.withColumn("bs_end", F.array_max(F.map_keys("assets")))
    at = lambda tag: F.try_element_at(F.col(tag), F.col("bs_end"))
    planned = F.map_filter("NextTwelveMonths", lambda end, _: (F.col("bs_end") - end).between(0, filings.STALE))
    due = filings.due_within_year(at("DebtCurrent"), at("LongTermDebtCurrent"), F.try_element_at(planned, F.array_max(F.map_keys(planned))), [at("ShortTermBorrowings")])
    maps = maps.select("cik", "assets", at("assets").alias("assets_now"), (at("Cash") + F.coalesce(at("ShortInvestments"), F.lit(0.0))).alias("cash"), due.alias("due"))
    filed = all_.groupBy("cik").agg(F.lit(True).alias("filed"))
    df = t.customer.select(F.col("c_custkey").alias("cik"), F.col("c_mktsegment").alias("sector"))
    for part in (filed, series, dna, maps, best):
        df = df.join(part, "cik", "left")
    last = F.try_element_at("series", F.lit(-1))["end"]
    financial = F.col("sector") == "BUILDING"
    excluded = F.when(F.col("filed").isNull(), "no SEC data").when(financial | last.isNull(), "not assessable").when(last < 9800, "no recent filings")
    note = F.when(F.col("filed").isNull(), "").when(financial, "sector excluded by this model").when(last.isNull(), "no fiscal-year history yet")
    empty = F.expr("cast(array() as array<struct<end:bigint,val:double>>)")
    df = df.withColumns({"excluded": excluded, "excluded_note": note})
    df = df.withColumns({"series": F.coalesce("series", empty), "dna": F.coalesce("dna", empty), "assets": F.coalesce("assets", F.expr("cast(map() as map<bigint,double>)"))})
    v = filings.viability(df)
    told = ["record", "covers", "positive_now", "worst_pct", "worst_end", "ocf_bn", "shock_bn", "cash_bn", "coverage", "interest_pct", "due_bn", "cash_months", "labor_bn", "notes"]
    scores = [r(c).alias(c) for c in ("cash_generation", "shock_absorption", "debt_service")]
    return v.select("cik", *scores, "index_value", "weakest", "level", *told, F.when(F.col("excluded").isNull() & F.col("due_ratio").isNotNull(), F.col("due_ratio") == float("inf")).alias("unpayable"))
