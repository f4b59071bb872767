"""Long tables of facts: building, choosing, reshaping, joining, set operations, aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import safe_div
from ledgerline.operators.dedupe import keep_first
from ledgerline.sources import connectors, paged, tables  # noqa: F401  (connectors register their scans)
from ledgerline.sources.shared import shared_folder

from .base import Tables, query, r

KINDS = ["click", "error", "purchase", "signup", "view"]
LABELS = {"click": ("Clicks", 1), "error": ("Errors", -1), "purchase": ("Purchases", 1), "signup": ("Sign-ups", 1), "view": ("Views", 0)}


def metrics(t: Tables) -> DataFrame:
    """The metric dimension: metric, label, direction."""
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(a).alias("label"), F.lit(b).cast("bigint").alias("direction")) for k, (a, b) in LABELS.items()])
    return t.spark.range(1).select(F.inline(rows))


DIM = "dim as (select * from (values " + ", ".join(f"('{k}', '{a}', {b})" for k, (a, b) in LABELS.items()) + ") d(metric, label, direction))"


@query(
    "q23_long_table_build",
    f"""with {DIM}, f as (select user_id, ts::date as day, event_type metric, value from events qualify row_number() over (partition by user_id, ts::date, event_type order by event_id) = 1)
 select user_id, cast(day as varchar) as day, metric, round(value, 6) as value, label, direction::bigint direction from f join dim using (metric)""",
)
def q23(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("metric"), "value", "event_id")
    first = keep_first(rows, ["user_id", "day", "metric"], [F.col("event_id")])
    return first.join(F.broadcast(metrics(t)), "metric").select("user_id", F.col("day").cast("string").alias("day"), "metric", r("value").alias("value"), "label", "direction")


@query(
    "q24_latest_wide",
    "with l as (select user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1) select user_id, "
    + ", ".join(f"round(max(value) filter (where event_type = '{k}'), 6) {k}_value" for k in KINDS) + " from l group by 1",
)
def q24(t: Tables) -> DataFrame:
    last = keep_first(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    wide = last.groupBy("user_id").pivot("event_type", KINDS).agg(F.first("value"))
    return wide.select("user_id", *[r(k).alias(f"{k}_value") for k in KINDS])


@query(
    "q25_last_non_null",
    "select user_id, event_type metric, round(arg_max(v, (ts, event_id)), 6) last_value from (select *, case when value > 20 then value end v from events) where v is not null group by 1, 2",
)
def q25(t: Tables) -> DataFrame:
    v = F.when(F.col("value") > 20, F.col("value"))
    last = F.max_by(v, F.when(v.isNotNull(), F.struct("ts", "event_id")))
    return t.events.groupBy("user_id", F.col("event_type").alias("metric")).agg(r(last).alias("last_value")).where("last_value is not null")


@query(
    "q26_priority_dedupe",
    """select o_custkey custkey, year(o_orderdate)::bigint as year, o_totalprice totalprice from orders
 qualify row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderpriority, o_orderkey) = 1""",
)
def q26(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("year", F.year("o_orderdate").cast("bigint"))
    return keep_first(rows, ["o_custkey", "year"], [F.col("o_orderpriority"), F.col("o_orderkey")]).select(F.col("o_custkey").alias("custkey"), "year", F.col("o_totalprice").alias("totalprice"))


@query(
    "q27_share_class_primary",
    """with k as (select p_brand grp, p_name name, p_partkey, row_number() over (partition by p_brand order by length(p_name) desc, p_name, p_partkey) n, count(*) over (partition by p_brand) c from part)
 select grp, name primary_name, p_partkey primary_key, c - 1 aliases from k where n = 1""",
)
def q27(t: Tables) -> DataFrame:
    order = F.struct((-F.length("p_name")).alias("l"), F.col("p_name").alias("name"), F.col("p_partkey").alias("key"))
    g = t.part.groupBy(F.col("p_brand").alias("grp")).agg(F.min(order).alias("top"), (F.count(F.lit(1)) - 1).alias("aliases"))
    return g.select("grp", F.col("top.name").alias("primary_name"), F.col("top.key").alias("primary_key"), "aliases")


@query(
    "q33_coverage_by_sector",
    """with c as (select distinct l_suppkey k from lineitem where l_discount > 0.05 and year(l_shipdate) = 2000)
 select coalesce(s_nationkey, -1)::bigint sector, count(s_suppkey) total, count(k) covered, round(100.0 * count(k) / count(s_suppkey), 4) pct from supplier full join c on s_suppkey = k group by 1""",
)
def q33(t: Tables) -> DataFrame:
    covered = t.lineitem.where((F.col("l_discount") > 0.05) & (F.year("l_shipdate") == 2000)).select(F.col("l_suppkey").alias("k")).distinct()
    both = t.supplier.join(covered, F.col("s_suppkey") == F.col("k"), "full")
    g = both.groupBy(F.coalesce("s_nationkey", F.lit(-1)).cast("bigint").alias("sector")).agg(F.count("s_suppkey").alias("total"), F.count("k").alias("covered"))
    return g.select("sector", "total", "covered", r(100.0 * safe_div(F.col("covered"), F.col("total")), 4).alias("pct"))


@query(
    "q34_set_ops",
    """with a as (select distinct o_custkey k from orders where year(o_orderdate) = 1996), b as (select distinct o_custkey k from orders where year(o_orderdate) = 1997)
 select 'union' op, k from (select k from a union select k from b) union all select 'intersect', k from (select k from a intersect select k from b) union all select 'except', k from (select k from a except select k from b)
 union all select 'symmetric', k from ((select k from a except select k from b) union (select k from b except select k from a))""",
)
def q34(t: Tables) -> DataFrame:
    year = lambda y: t.orders.where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("k")).distinct()
    a, b = year(1996), year(1997)
    # One aggregation tells all four sets apart.
    sides = a.select("k", F.lit(1).alias("s")).unionAll(b.select("k", F.lit(2).alias("s"))).groupBy("k").agg(F.sum("s").alias("s"))
    ops = F.array_compact(
        F.array(
            F.lit("union"), F.when(F.col("s") == 3, "intersect"), F.when(F.col("s") == 1, "except"), F.when(F.col("s") != 3, "symmetric")
        )
    )
    return sides.select(F.explode(ops).alias("op"), "k")


@query(
    "q35_semi_anti",
    """select 'with' kind, count(*) n, sum(c_custkey)::bigint keys from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)
 union all select 'without', count(*), sum(c_custkey)::bigint from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)""",
)
def q35(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 300000").select("o_custkey")
    part = lambda how, name: (
        t.customer.join(big, F.col("o_custkey") == F.col("c_custkey"), how).agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))
    )
    return part("left_semi", "with").unionByName(part("left_anti", "without"))


WINDOWS = [(1, 1996, 1998), (2, None, 1997), (3, 1999, None), (4, 1995, 2001), (5, 2000, 2000)]


@query(
    "q36_validity_interval_join",
    "with w as (select * from (values " + ", ".join(f"({k}, {a if a else 'null'}, {b if b else 'null'})" for k, a, b in WINDOWS) + ") w(k, lo, hi)), s as (select l_suppkey suppkey, year(l_shipdate)::bigint as year, sum(l_quantity) q from lineitem group by 1, 2)"
    " select suppkey, year, (k is null or (year >= coalesce(lo, -9999) and year <= coalesce(hi, 9999))) as valid, round(q, 4) total from s left join w on suppkey = k",
)
def q36(t: Tables) -> DataFrame:
    null = F.lit(None).cast("bigint")
    cell = lambda x: F.lit(x).cast("bigint") if x else null
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), cell(a).alias("lo"), cell(b).alias("hi")) for k, a, b in WINDOWS])
    windows = t.spark.range(1).select(F.inline(rows))
    sums = t.lineitem.groupBy(F.col("l_suppkey").alias("suppkey"), F.year("l_shipdate").cast("bigint").alias("year")).agg(F.sum("l_quantity").alias("q"))
    inside = F.col("k").isNull() | F.col("year").between(F.coalesce("lo", F.lit(-9999)), F.coalesce("hi", F.lit(9999)))
    return sums.join(F.broadcast(windows), F.col("suppkey") == F.col("k"), "left").select("suppkey", "year", inside.alias("valid"), r("q", 4).alias("total"))


@query(
    "q37_pairwise_decidable",
    """with b as (select l_suppkey k, s_nationkey sector, quantile_cont(l_extendedprice, 0.4) lo, quantile_cont(l_extendedprice, 0.6) hi from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2)
 select x.sector::bigint sector, count(*) pairs, round(avg((x.hi < y.lo or y.hi < x.lo)::double), 6) decidable from b x join b y on x.sector = y.sector and x.k < y.k group by 1""",
)
def q37(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    q = F.percentile("l_extendedprice", F.array(F.lit(0.4), F.lit(0.6)))
    b = rows.groupBy("l_suppkey", "s_nationkey").agg(q.alias("q")).select(F.col("l_suppkey").alias("k"), F.col("s_nationkey").alias("sector"), F.element_at("q", 1).alias("lo"), F.element_at("q", 2).alias("hi"))
    # Pairs (i < j) that are decidable: for each i, those whose interval ends before or starts after it.
    # Counted without pairs: intervals of a sector are compared through their ranks.
    ends = b.select("sector", F.col("lo").alias("x"), F.lit(0).alias("is_hi")).unionAll(b.select("sector", F.col("hi").alias("x"), F.lit(1).alias("is_hi")))
    w = Window.partitionBy("sector").orderBy("x", "is_hi").rowsBetween(Window.unboundedPreceding, -1)
    before = F.when(F.col("is_hi") == 0, F.coalesce(F.sum("is_hi").over(w), F.lit(0)))
    counted = ends.withColumn("before", before).groupBy("sector").agg(F.sum("before").alias("d"), F.count("before").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return counted.where("n > 1").select(F.col("sector").cast("bigint").alias("sector"), pairs.cast("bigint").alias("pairs"), r(F.col("d") / pairs).alias("decidable"))


@query(
    "q53_json_ledger",
    """select user_id, sum(json_extract(props, '$.k')::bigint)::bigint k_sum, count(*) n, max(json_extract(props, '$.k')::bigint) k_max from events group by 1""",
)
def q53(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.groupBy("user_id").agg(F.sum(k).alias("k_sum"), F.count(F.lit(1)).alias("n"), F.max(k).alias("k_max"))


@query(
    "q54_silence_bounds",
    """with c as (select user_id, round(avg(value), 6) cur, count(distinct event_type) n from events group by 1)
 select user_id, round(cur * n / 5, 4) lo, round((cur * n + 50 * (5 - n)) / 5, 4) mid, round((cur * n + 100 * (5 - n)) / 5, 4) hi from c""",
)
def q54(t: Tables) -> DataFrame:
    c = t.events.groupBy("user_id").agg(r(F.avg("value")).alias("cur"), F.countDistinct("event_type").alias("n"))
    bound = lambda x: r((F.col("cur") * F.col("n") + F.lit(float(x)) * (5 - F.col("n"))) / 5, 4)
    return c.select("user_id", bound(0).alias("lo"), bound(50).alias("mid"), bound(100).alias("hi"))


@query(
    "q55_overlap_matrix",
    """with w as (select s_nationkey a, p_type, sum(l_quantity) / sum(sum(l_quantity)) over (partition by s_nationkey) w from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1, 2)
 select x.a::bigint a, y.a::bigint b, round(sum(least(x.w, y.w)), 6) overlap from w x join w y on x.p_type = y.p_type and x.a < y.a group by 1, 2""",
)
def q55(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    sums = rows.groupBy(F.col("s_nationkey").alias("a"), "p_type").agg(F.sum("l_quantity").alias("q"))
    w = sums.select("a", "p_type", (F.col("q") / F.sum("q").over(Window.partitionBy("a"))).alias("w"))
    other = w.select(F.col("a").alias("b"), "p_type", F.col("w").alias("v"))
    # A matrix over a dimension (nations by types), small however many facts there are.
    return w.join(other, "p_type").where("a < b").groupBy(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).agg(r(F.sum(F.least("w", "v"))).alias("overlap"))


@query(
    "q56_pab_path",
    """with y as (select l_suppkey suppkey, min(year(l_shipdate))::bigint base_year from lineitem group by 1), b as (select l_suppkey suppkey, base_year, sum(l_quantity) base from lineitem join y on suppkey = l_suppkey and year(l_shipdate) = base_year group by 1, 2)
 select suppkey, base_year + i as year, round(base * pow(0.93, i), 4) allowed from b cross join range(16) s(i)""",
)
def q56(t: Tables) -> DataFrame:
    """The path from every issuer's own base year that falls by 7 % a year."""
    yearly = t.lineitem.groupBy(F.col("l_suppkey").alias("suppkey"), F.year("l_shipdate").cast("bigint").alias("year")).agg(F.sum("l_quantity").alias("q"))
    base = yearly.groupBy("suppkey").agg(F.min("year").alias("base_year"), F.min_by("q", "year").alias("base"))
    steps = base.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))))
    return steps.select("suppkey", (F.col("base_year") + F.col("i")).alias("year"), r(F.col("base") * F.pow(F.lit(0.93), F.col("i")), 4).alias("allowed"))


def scanned(t: Tables, rows: DataFrame, name: str, kind: str) -> DataFrame:
    """What the scan of a source gives for rows that are written as its files."""
    path = f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
    (rows.write.csv(path, header=True) if kind == "csv" else rows.write.json(path))
    return tables.get(name)(t.spark, path)


@query(
    "q114_scan_facilities",
    """with f as (select o_custkey facility_id, year(o_orderdate)::int as year, o_orderpriority facility_name, o_orderstatus state from orders)
 select facility_id, year, facility_name, state from f qualify row_number() over (partition by facility_id, year order by facility_name, state) = 1""",
)
def q114(t: Tables) -> DataFrame:
    """Orders as the facilities' CSV files: one row a facility and year, whichever rows repeat."""
    rows = t.orders.select(
        F.col("o_custkey").alias("FACILITY_ID"), F.year("o_orderdate").alias("YEAR"), F.col("o_orderpriority").alias("FACILITY_NAME"), F.col("o_orderstatus").alias("STATE")
    )
    return scanned(t, rows, "facilities", "csv").select("facility_id", "year", "facility_name", "state")


@query(
    "q115_scan_facility_emissions",
    """with d as (select l_suppkey facility_id, year(l_shipdate)::bigint as year, l_linenumber + 3 sector, l_partkey % 5 sub, case when l_returnflag = 'A' then 8 else 1 end gas, max(l_quantity) q from lineitem group by 1, 2, 3, 4, 5),
 s as (select facility_id, year, sum(q) filter (sector <= 8 and gas <> 8) a, sum(q) filter (sector <= 8 and gas = 8) b, sum(q) filter (sector > 8) c from d group by 1, 2)
 select facility_id, year, round(coalesce(a, 0), 4) scope1_t, round(case when a is not null then coalesce(b, 0) else 0 end, 4) biogenic_t, round(coalesce(c, 0), 4) supplied_t from s where a is not null or c is not null""",
)
def q115(t: Tables) -> DataFrame:
    """Lines as the emissions' CSV files: distinct rows, direct sectors without and with biogenic gas, suppliers."""
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("facility_id"), F.year("l_shipdate").alias("year"), (F.col("l_linenumber") + 3).alias("sector_id"), (F.col("l_partkey") % 5).alias("subsector_id"),
        F.when(F.col("l_returnflag") == "A", 8).otherwise(1).alias("gas_id"), F.col("l_quantity").alias("co2e_emission"),
    )
    found = scanned(t, rows, "facility_emissions", "csv")
    return found.select("facility_id", "year", *[r(c, 4).alias(c) for c in ("scope1_t", "biogenic_t", "supplied_t")])


@query(
    "q116_scan_unit_emissions",
    """select o_custkey facility_id, year(o_orderdate)::bigint as year, min(o_orderpriority) facility_name, round(sum(o_totalprice) * 0.90718474, 3) co2_t, round(sum(o_totalprice) / 2, 3) gross_load_mwh, count(distinct o_orderstatus) n_units from orders group by 1, 2""",
)
def q116(t: Tables) -> DataFrame:
    """Orders as the units' JSON files: facility years in tonnes with their units counted."""
    rows = t.orders.select(
        F.col("o_custkey").alias("facilityId"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("facilityName"), F.lit("XX").alias("stateCode"),
        F.col("o_orderstatus").alias("unitId"), F.col("o_totalprice").alias("co2Mass"), (F.col("o_totalprice") / 2).alias("grossLoad"),
    )
    found = scanned(t, rows, "unit_emissions", "json")
    return found.select(F.col("facilityId").alias("facility_id"), "year", "facility_name", r("co2_t", 3).alias("co2_t"), r("gross_load_mwh", 3).alias("gross_load_mwh"), "n_units")


@query("q112_paged_source", "select c_custkey, c_name, c_nationkey, round(c_acctbal, 4) c_acctbal from customer")
def q112(t: Tables) -> DataFrame:
    """The table of customers through a paged interface: written as pages, read back a page a task."""
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    path = f"{shared_folder(t.spark)}/pages-{uuid.uuid4().hex}"
    paged.write_pages(rows, "c_custkey", path, 1000)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double"
    return paged.read_pages(t.spark, path, schema, 1000, ["c_custkey", "c_name"]).withColumn("c_acctbal", r("c_acctbal", 4))


DOCUMENT = """yr as (select o_custkey k, year(o_orderdate)::bigint as year, o_orderpriority metric, sum(o_totalprice) v, count(*) n from orders group by 1, 2, 3),
 axes as (select k, metric, max(v) best, sum(n) n from yr group by 1, 2),
 rows as (select c_custkey k, 0 kind, '' a, 0 b, '"name":"' || c_name || '","segment":"' || c_mktsegment || '"' body from customer
  union all select k, 1, metric, 0, '{"axis":"' || metric || '","best":"' || round(best, 2)::decimal(30,2) || '","n":' || n || '}' from axes
  union all select k, 2, metric, year, '{"metric":"' || metric || '","year":' || year || ',"value":"' || round(v, 2)::decimal(30,2) || '","status":"' || case when n = 1 then 'reported' else 'aggregated' end || '"}' from yr
  union all select k, 3, metric, 0, '{"lever":"' || metric || '","gain":"' || round(best * 100)::bigint // 10 || '"}' from axes where n >= 2)"""


@query(
    "q113_firm_documents",
    f"""with {DOCUMENT}, j as (select k, max(body) filter (kind = 0) head, string_agg(body, ',' order by a) filter (kind = 1) axes, string_agg(body, ',' order by a, b) filter (kind = 2) ledger, string_agg(body, ',' order by a) filter (kind = 3) levers from rows group by 1)
 select k as key, '{{' || head || ',"axes":[' || coalesce(axes, '') || '],"ledger":[' || coalesce(ledger, '') || '],"levers":[' || coalesce(levers, '') || ']}}' as document from j where head is not null""",
)
def q113(t: Tables) -> DataFrame:
    """One document a firm: axes, ledger and levers are tagged rows of one union, grouped once into nested arrays, and written once."""
    yearly = t.orders.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("metric")).agg(
        F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n")
    )
    axes = yearly.groupBy("k", "metric").agg(F.max("v").alias("best"), F.sum("n").alias("n"))
    money = lambda x: F.round(x, 2).cast("decimal(30,2)").cast("string")
    kinds = {"head": "struct<name:string,segment:string>", "axis": "struct<axis:string,best:string,n:bigint>", "entry": "struct<metric:string,year:bigint,value:string,status:string>", "lever": "struct<lever:string,gain:string>"}

    def tagged(df: DataFrame, key: str, kind: str, *fields) -> DataFrame:
        made = {k: F.struct(*fields) if k == kind else F.lit(None).cast(kinds[k]) for k in kinds}
        return df.select(F.col(key).alias("key"), *[x.alias(k) for k, x in made.items()])

    status = F.when(F.col("n") == 1, "reported").otherwise("aggregated")
    rows = tagged(t.customer, "c_custkey", "head", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    rows = rows.unionByName(tagged(axes, "k", "axis", F.col("metric").alias("axis"), money(F.col("best")).alias("best"), "n"))
    rows = rows.unionByName(tagged(yearly, "k", "entry", "metric", "year", money(F.col("v")).alias("value"), status.alias("status")))
    rows = rows.unionByName(tagged(axes.where("n >= 2"), "k", "lever", F.col("metric").alias("lever"), F.expr("cast(cast(round(best * 100) as bigint) div 10 as string)").alias("gain")))
    listed = lambda c: F.array_sort(F.collect_list(c))
    one = rows.groupBy("key").agg(F.max("head").alias("head"), listed("axis").alias("axes"), listed("entry").alias("ledger"), listed("lever").alias("levers")).where("head is not null")
    return one.select("key", F.to_json(F.struct("head.name", "head.segment", "axes", "ledger", "levers")).alias("document"))


@query(
    "q63_materiality_mix",
    """with s as (select l_suppkey suppkey, p_type topic, sum(l_quantity) q from lineitem join part on p_partkey = l_partkey group by 1, 2), w as (select *, q / sum(q) over (partition by suppkey) share from s)
 select suppkey, topic, round(share, 6) share, share >= 0.2 material, row_number() over (partition by suppkey order by share desc, topic) as rk from w""",
)
def q63(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    sums = rows.groupBy(F.col("l_suppkey").alias("suppkey"), F.col("p_type").alias("topic")).agg(F.sum("l_quantity").alias("q"))
    sums = sums.withColumn("share", F.col("q") / F.sum("q").over(Window.partitionBy("suppkey")))
    rk = F.row_number().over(Window.partitionBy("suppkey").orderBy(F.desc("share"), "topic")).cast("bigint")
    return sums.select("suppkey", "topic", r("share").alias("share"), (F.col("share") >= 0.2).alias("material"), rk.alias("rk"))


@query(
    "q65_top_k_per_group",
    """with c as (select p_brand grp, p_name name, count(*) n from lineitem join part on p_partkey = l_partkey group by 1, 2)
 select grp, name, n from c qualify row_number() over (partition by grp order by n desc, name) <= 3""",
)
def q65(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    counts = rows.groupBy(F.col("p_brand").alias("grp"), F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return keep_first(counts, ["grp"], [F.desc("n"), F.col("name")], 3)


@query(
    "q66_typed_scan_projection",
    """select s_suppkey suppkey, replace(trim(s_name), '#', '-') ticker, try_cast(regexp_extract(s_name, '(\\d+)$', 1) as bigint) cik, try_cast(s_name as double) bad, round(s_acctbal / 1e3, 6) bal_k,
 row_number() over (order by s_suppkey) as surrogate from supplier where s_acctbal is not null""",
)
def q66(t: Tables) -> DataFrame:
    name = F.col("s_name")
    return t.supplier.where("s_acctbal is not null").select(
        F.col("s_suppkey").alias("suppkey"), F.replace(F.trim(name), F.lit("#"), F.lit("-")).alias("ticker"),
        F.expr(r"try_cast(regexp_extract(s_name, '(\\d+)$', 1) as bigint)").alias("cik"), F.expr("try_cast(s_name as double)").alias("bad"),
        r(F.col("s_acctbal") / 1e3).alias("bal_k"), F.row_number().over(Window.orderBy("s_suppkey")).cast("bigint").alias("surrogate"),
    )


@query(
    "q67_paged_union_dedupe",
    """with u as (select * from lineitem where year(l_shipdate) <= 1998 union all select * from lineitem where year(l_shipdate) >= 1998)
 select l_partkey partkey, year(l_shipdate)::bigint as year, l_suppkey suppkey, l_quantity quantity from u
 qualify row_number() over (partition by l_partkey, year(l_shipdate) order by l_orderkey, l_linenumber, l_suppkey, l_quantity) = 1""",
)
def q67(t: Tables) -> DataFrame:
    year = F.year("l_shipdate")
    pages = t.lineitem.where(year <= 1998).unionByName(t.lineitem.where(year >= 1998)).withColumn("year", year.cast("bigint"))
    first = keep_first(pages, ["l_partkey", "year"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")])
    return first.select(F.col("l_partkey").alias("partkey"), "year", F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").alias("quantity"))


@query(
    "q68_json_explode",
    """select event_id id, unnest(json_keys(props)) as key, json_extract_string(props, '$.k') as value from events""",
)
def q68(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), F.explode(F.json_object_keys("props")).alias("key"), F.get_json_object("props", "$.k").alias("value"))


@query(
    "q70_masks_and_membership",
    """select o_orderkey orderkey, o_orderstatus in ('F', 'O') final, o_orderpriority like '1%' urgent, nullif(o_orderstatus, 'P') status, case when o_totalprice > 100000 then o_totalprice end large,
 o_orderdate >= timestamp '2000-01-01' and o_orderdate < timestamp '2001-01-01' in_year from orders""",
)
def q70(t: Tables) -> DataFrame:
    date = F.col("o_orderdate")
    return t.orders.select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").isin("F", "O").alias("final"), F.col("o_orderpriority").startswith("1").alias("urgent"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("large"),
        ((date >= F.lit("2000-01-01").cast("timestamp")) & (date < F.lit("2001-01-01").cast("timestamp"))).alias("in_year"),
    )


@query(
    "q71_tiers_clips_polarity",
    """with s as (select l_suppkey k, avg(l_quantity) q, avg(1 - l_discount) m, count(*) n from lineitem group by 1)
 select k as key, case when q >= 26 then 'high' when q >= 25 then 'mid' else 'low' end tier, round(greatest(24, least(27, q)), 6) clipped, round(-log10(q), 6) oriented, round(greatest(0.03, least(0.6, 0.05 + 0.5 * (1 - m) + 0.1 / sqrt(n))), 6) rel_se from s""",
)
def q71(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("key")).agg(F.avg("l_quantity").alias("q"), F.avg(1 - F.col("l_discount")).alias("m"), F.count(F.lit(1)).alias("n"))
    q = F.col("q")
    return s.select(
        "key", F.when(q >= 26, "high").when(q >= 25, "mid").otherwise("low").alias("tier"), r(F.greatest(F.lit(24.0), F.least(F.lit(27.0), q))).alias("clipped"), r(-F.log10(q)).alias("oriented"),
        r(F.greatest(F.lit(0.03), F.least(F.lit(0.6), 0.05 + 0.5 * (1 - F.col("m")) + 0.1 / F.sqrt("n")))).alias("rel_se"),
    )


@query(
    "q73_company_aggregates",
    """select l_suppkey suppkey, count(distinct l_partkey) n_parts, round(sum(l_quantity), 4) q, round(avg(l_discount), 6) d, count(*) filter (where l_returnflag = 'R') returns, min(l_shipdate)::date::varchar first_day, count(distinct year(l_shipdate)) as "years",
 round(stddev_samp(l_quantity), 6) sd from lineitem group by 1""",
)
def q73(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("suppkey")).agg(
        F.countDistinct("l_partkey").alias("n_parts"), r(F.sum("l_quantity"), 4).alias("q"), r(F.avg("l_discount")).alias("d"),
        F.count_if(F.col("l_returnflag") == "R").alias("returns"), F.to_date(F.min("l_shipdate")).cast("string").alias("first_day"),
        F.countDistinct(F.year("l_shipdate")).alias("years"), r(F.stddev_samp("l_quantity")).alias("sd"),
    )


@query(
    "q74_two_level_rate",
    """with o as (select o_custkey, o_orderkey, max(o_totalprice) as "hours", count(l_linenumber) cases from orders join lineitem on l_orderkey = o_orderkey and l_returnflag = 'R' group by 1, 2)
 select o_custkey custkey, sum(cases)::bigint cases, round(sum("hours"), 4) as "hours", round(sum(cases) * 200000 / sum("hours"), 6) rate, round(sqrt(sum(cases)) * 200000 / sum("hours"), 6) rate_se from o group by 1""",
)
def q74(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"))
    one = rows.groupBy("o_custkey", "o_orderkey").agg(F.max("o_totalprice").alias("hours"), F.count("l_linenumber").alias("cases"))
    g = one.groupBy(F.col("o_custkey").alias("custkey")).agg(F.sum("cases").alias("cases"), F.sum("hours").alias("h"))
    return g.select("custkey", "cases", r("h", 4).alias("hours"), r(F.col("cases") * 200000 / F.col("h")).alias("rate"), r(F.sqrt("cases") * 200000 / F.col("h")).alias("rate_se"))


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "q76_pivot_share",
    "with s as (select l_suppkey suppkey, p_type, count(*)::double n from lineitem join part on p_partkey = l_partkey group by 1, 2), w as (select suppkey, sum(n) total, "
    + ", ".join(f"coalesce(max(n) filter (where p_type like '{k}%'), 0) s_{k.lower()}" for k in TYPES) + " from s group by 1) select suppkey, total::bigint total, "
    + ", ".join(f"round(s_{k.lower()} / total, 6) s_{k.lower()}" for k in TYPES) + ", round(sqrt((s_promo / total) * (1 - s_promo / total) / total), 6) promo_se from w",
)
def q76(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).withColumn("kind", F.substring_index("p_type", " ", 1))
    wide = rows.groupBy(F.col("l_suppkey").alias("suppkey")).pivot("kind", TYPES).count().na.fill(0)
    total = sum((F.col(k) for k in TYPES), F.lit(0))
    promo = F.col("PROMO") / F.col("total")
    wide = wide.withColumn("total", total.cast("bigint"))
    return wide.select("suppkey", "total", *[r(F.col(k) / F.col("total")).alias(f"s_{k.lower()}") for k in TYPES], r(F.sqrt(promo * (1 - promo) / F.col("total"))).alias("promo_se"))


@query(
    "q77_lists_and_ranges",
    """select event_type, array_to_string(list_sort(list(distinct user_id)), ',') users, min(ts)::date::varchar first_day, max(ts)::date::varchar last_day, max(ts) < timestamp '2024-01-20' stale from events where value > 99 group by 1""",
)
def q77(t: Tables) -> DataFrame:
    users = F.array_join(F.array_sort(F.collect_set("user_id")), ",")
    day = lambda c: F.to_date(c).cast("string")
    return t.events.where("value > 99").groupBy("event_type").agg(
        users.alias("users"), day(F.min("ts")).alias("first_day"), day(F.max("ts")).alias("last_day"), (F.max("ts") < F.lit("2024-01-20").cast("timestamp")).alias("stale")
    )


@query(
    "q79_variant_pivot_totals",
    """select l_returnflag rule, threshold::bigint threshold, count(*) filter (where l_quantity >= threshold) n, count(*) total from lineitem cross join (select unnest([10, 25, 40]) threshold) group by 1, 2""",
)
def q79(t: Tables) -> DataFrame:
    # One pass over the facts, whatever the number of thresholds.
    counts = t.lineitem.groupBy(F.col("l_returnflag").alias("rule")).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("l_quantity") >= x).alias(f"n{x}") for x in (10, 25, 40)]
    )
    rows = F.array(*[F.struct(F.lit(x).cast("bigint").alias("threshold"), F.col(f"n{x}").alias("n")) for x in (10, 25, 40)])
    return counts.select("rule", "total", F.inline(rows))


@query(
    "q80_join_shapes",
    """select 'inner' shape, count(*) n, round(sum(l_quantity), 2) total from lineitem join part on p_partkey = l_partkey and p_size > 25
 union all select 'left', count(*), round(sum(coalesce(p_retailprice, 0)), 2) from lineitem left join part on p_partkey = l_partkey and p_size > 25
 union all select 'full', count(*), round(sum(coalesce(c_acctbal, 0)), 2) from customer full join (select * from orders where o_totalprice > 450000) on o_custkey = c_custkey
 union all select 'semi', count(*), round(sum(s_acctbal), 2) from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity >= 50 and l_discount = 0.1)
 union all select 'anti', count(*), round(sum(c_acctbal), 2) from customer where c_custkey not in (select o_custkey from orders)
 union all select 'two keys', count(*), round(sum(a.q), 2) from (select l_partkey, l_suppkey, sum(l_quantity) q from lineitem group by 1, 2) a join (select distinct l_partkey, l_suppkey from lineitem where l_returnflag = 'R') b on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey""",
)
def q80(t: Tables) -> DataFrame:
    big = t.part.where("p_size > 25")
    on_part = F.col("p_partkey") == F.col("l_partkey")
    tell = lambda df, shape, x: df.agg(F.lit(shape).alias("shape"), F.count(F.lit(1)).alias("n"), r(F.sum(x), 2).alias("total"))
    sums = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    returned = t.lineitem.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey")
    parts = [
        tell(t.lineitem.join(big, on_part), "inner", F.col("l_quantity")),
        tell(t.lineitem.join(big, on_part, "left"), "left", F.coalesce("p_retailprice", F.lit(0.0))),
        tell(t.customer.join(t.orders.where("o_totalprice > 450000"), F.col("o_custkey") == F.col("c_custkey"), "full"), "full", F.coalesce("c_acctbal", F.lit(0.0))),
        tell(t.supplier.join(t.lineitem.where("l_quantity >= 50 and l_discount = 0.1"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi"), "semi", F.col("s_acctbal")),
        tell(t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "anti", F.col("c_acctbal")),
        tell(sums.join(returned, ["l_partkey", "l_suppkey"], "left_semi"), "two keys", F.col("q")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "q83_coverage_gate",
    """with u as (select user_id, """ + ", ".join(f"max(value) filter (where event_type = '{k}' and value > 30) {k}" for k in KINDS) + " from events group by 1) "
    + " union all ".join(f"select '{k}' metric, round(avg(({k} is not null)::double), 6) coverage, avg(({k} is not null)::double) >= 0.6 gate from u" for k in KINDS),
)
def q83(t: Tables) -> DataFrame:
    wide = t.events.groupBy("user_id").pivot("event_type", KINDS).agg(F.max(F.when(F.col("value") > 30, F.col("value"))))
    row = wide.agg(*[F.avg(F.col(k).isNotNull().cast("double")).alias(k) for k in KINDS])
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), r(k).alias("coverage"), (F.col(k) >= 0.6).alias("gate")) for k in KINDS])
    return row.select(F.inline(rows))


@query(
    "q86_ordering_rules",
    """select o_custkey custkey, o_orderkey orderkey, row_number() over (partition by o_custkey order by nullif(o_orderstatus, 'P') nulls last, o_totalprice desc, o_orderkey) as rk from orders""",
)
def q86(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.nullif("o_orderstatus", F.lit("P")).asc_nulls_last(), F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.row_number().over(w).cast("bigint").alias("rk"))


@query(
    "q87_stable_ids",
    """select o_orderkey orderkey, substr(sha256(concat_ws('|', o_custkey, o_orderkey, o_orderstatus)), 1, 16) id, substr(sha256(concat_ws('|', 'cache', o_orderpriority, o_orderkey)), 1, 24) cache_key from orders""",
)
def q87(t: Tables) -> DataFrame:
    digest = lambda n, *c: F.substring(F.sha2(F.concat_ws("|", *c), 256), 1, n)
    return t.orders.select(
        F.col("o_orderkey").alias("orderkey"), digest(16, F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("id"),
        digest(24, F.lit("cache"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("cache_key"),
    )
