"""Attribution, panels, trends, and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import percentile_rank, positive, safe_div
from ledgerline.operators import panel
from ledgerline.operators.dedupe import keep_first
from ledgerline.operators.ranking import average_ranks

from .base import Tables, query, r

ATT = """att as (select l_suppkey suppkey, year(l_shipdate)::bigint as year, sum(l_quantity * (1 - l_discount)) attributed,
 count(distinct l_partkey) n_facilities, avg(1 - l_discount) confidence from lineitem group by 1, 2)"""
REV = """rev as (select l_suppkey suppkey, year(o_orderdate)::bigint as year, sum(l_extendedprice) / 1e6 revenue_musd
 from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"""
PANEL = f"""{ATT}, {REV}, panel as (select att.*, revenue_musd, attributed / nullif(case when revenue_musd > 0 then revenue_musd end, 0) intensity
 from att left join rev using (suppkey, year))"""


def attribution(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumnRenamed("l_suppkey", "suppkey")
    return panel.attribute(rows, "suppkey", F.year("l_shipdate"), F.col("l_quantity"), 1 - F.col("l_discount"), "l_partkey")


def company_year(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = lines.groupBy(F.col("l_suppkey").alias("suppkey"), F.year("o_orderdate").cast("bigint").alias("year")).agg(
        (F.sum("l_extendedprice") / 1e6).alias("revenue_musd")
    )
    return panel.intensity(attribution(t), revenue, ["suppkey", "year"])


@query("q01_company_year_attribution", f"with {ATT} select suppkey, year, round(attributed, 4) attributed, n_facilities, round(confidence, 6) confidence from att")
def q01(t: Tables) -> DataFrame:
    return attribution(t).select("suppkey", "year", r("attributed", 4).alias("attributed"), "n_facilities", r("confidence").alias("confidence"))


@query(
    "q02_intensity_panel",
    f"""with {PANEL} select p.suppkey, p.year, n_name peer, r_name sector, round(attributed, 4) attributed, round(revenue_musd, 6) revenue_musd, round(intensity, 4) intensity
 from panel p join supplier on s_suppkey = suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey""",
)
def q02(t: Tables) -> DataFrame:
    issuers = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(
        F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return company_year(t).join(issuers, F.col("suppkey") == F.col("s_suppkey")).select(
        "suppkey", "year", F.col("n_name").alias("peer"), F.col("r_name").alias("sector"), r("attributed", 4).alias("attributed"),
        r("revenue_musd").alias("revenue_musd"), r("intensity", 4).alias("intensity"),
    )


@query(
    "q03_trend_growth",
    f"""with {ATT}, a as (select suppkey, regr_slope(ln(attributed), year) s, count(*) n, arg_min(attributed, year) b, median(attributed) m from att where attributed > 0 group by 1),
 g as (select suppkey, case when n >= 3 then exp(s) - 1 end growth, n n_years, b / nullif(m, 0) base_ratio from a)
 select suppkey, round(growth, 6) growth, n_years, round(base_ratio, 6) base_ratio, n_years >= 3 and base_ratio between 0.2 and 2.5 and abs(growth) <= 1 eligible from g""",
)
def q03(t: Tables) -> DataFrame:
    return panel.trend(attribution(t), "suppkey", "year", "attributed").select(
        "suppkey", r("growth").alias("growth"), "n_years", r("base_ratio").alias("base_ratio"), "eligible"
    )


@query(
    "q04_ols_slope_se",
    f"""with {ATT}, a as (select suppkey, regr_slope(ln(attributed), year) slope, count(*) n, regr_sxx(ln(attributed), year) sxx, regr_syy(ln(attributed), year) syy, regr_sxy(ln(attributed), year) sxy,
 regr_slope(ln(attributed), year) filter (where year >= 1999) short from att where attributed > 0 group by 1)
 select suppkey, round(slope, 6) slope, round(sqrt(greatest(0, syy - sxy * sxy / sxx) / (n - 2)) / sqrt(sxx), 6) slope_se, round(sqrt(greatest(0, syy - sxy * sxy / sxx) / (n - 2)), 6) resid_sd, round(short - slope, 6) momentum from a""",
)
def q04(t: Tables) -> DataFrame:
    base = attribution(t)
    short = base.where("year >= 1999 and attributed > 0").groupBy("suppkey").agg(F.expr("regr_slope(ln(attributed), year)").alias("short"))
    return panel.ols(base, "suppkey", "year", "attributed").join(short, "suppkey", "left").select(
        "suppkey", r("slope").alias("slope"), r("slope_se").alias("slope_se"), r("resid_sd").alias("resid_sd"), r(F.col("short") - F.col("slope")).alias("momentum")
    )


@query(
    "q05_panel_latest",
    f"""with {PANEL}, a as (select suppkey, max(year) last_year, arg_max(attributed, year) latest, arg_min(attributed, year) base, arg_max(intensity, year) i1, arg_min(intensity, year) i0 from panel group by 1)
 select suppkey, last_year, round(latest, 4) latest, round(base, 4) base, i1 < i0 and latest > base illusion, latest / nullif(base, 0) > 1.1 base_year_flag from a""",
)
def q05(t: Tables) -> DataFrame:
    agg = company_year(t).groupBy("suppkey").agg(
        F.max("year").alias("last_year"), F.max_by("attributed", "year").alias("latest"), F.min_by("attributed", "year").alias("base"),
        F.max_by("intensity", "year").alias("i1"), F.min_by("intensity", "year").alias("i0"),
    )
    return agg.select(
        "suppkey", "last_year", r("latest", 4).alias("latest"), r("base", 4).alias("base"),
        ((F.col("i1") < F.col("i0")) & (F.col("latest") > F.col("base"))).alias("illusion"),
        (safe_div(F.col("latest"), F.col("base")) > 1.1).alias("base_year_flag"),
    )


@query(
    "q28_conditional_sums",
    """select l_suppkey suppkey, year(l_shipdate)::bigint as year, round(coalesce(sum(case when l_returnflag in ('A', 'R') then l_quantity end), 0), 4) direct,
 round(coalesce(sum(case when l_returnflag = 'R' then l_quantity end), 0), 4) biogenic, round(coalesce(sum(case when l_returnflag = 'N' then l_quantity end), 0), 4) supplied from lineitem group by 1, 2""",
)
def q28(t: Tables) -> DataFrame:
    part = lambda *flags: r(F.coalesce(F.sum(F.when(F.col("l_returnflag").isin(*flags), F.col("l_quantity"))), F.lit(0.0)), 4)
    return t.lineitem.groupBy(F.col("l_suppkey").alias("suppkey"), F.year("l_shipdate").cast("bigint").alias("year")).agg(
        part("A", "R").alias("direct"), part("R").alias("biogenic"), part("N").alias("supplied")
    )


@query(
    "q29_largest_owner_control",
    """select l_partkey partkey, year(l_shipdate)::bigint as year, l_suppkey controlling from lineitem
 qualify row_number() over (partition by l_partkey, year(l_shipdate) order by 1 - l_discount desc, l_suppkey, l_linenumber, l_quantity, l_orderkey) = 1""",
)
def q29(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("year", F.year("l_shipdate").cast("bigint"))
    first = keep_first(rows, ["l_partkey", "year"], [(1 - F.col("l_discount")).desc(), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_quantity"), F.col("l_orderkey")])
    return first.select(F.col("l_partkey").alias("partkey"), "year", F.col("l_suppkey").alias("controlling"))


@query(
    "q30_hhi",
    """with s as (select l_suppkey suppkey, l_partkey, sum(l_quantity) q from lineitem group by 1, 2), w as (select *, q / sum(q) over (partition by suppkey) w from s)
 select suppkey, round(sum(w * w), 6) hhi, round(max(w), 6) top1, count(*) n, round(2 * sqrt(sum(w * w * w * w) / count(*)), 6) hhi_se from w group by 1""",
)
def q30(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy(F.col("l_suppkey").alias("suppkey"), "l_partkey").agg(F.sum("l_quantity").alias("q"))
    w = F.col("q") / F.sum("q").over(Window.partitionBy("suppkey"))
    squared = F.col("w") * F.col("w")
    return sums.withColumn("w", w).groupBy("suppkey").agg(
        r(F.sum(squared)).alias("hhi"), r(F.max("w")).alias("top1"), F.count(F.lit(1)).alias("n"),
        r(2 * F.sqrt(F.sum(squared * squared) / F.count(F.lit(1)))).alias("hhi_se"),
    )


@query(
    "q38_previous_year_gap",
    f"""with {ATT}, p as (select suppkey, year, attributed, lag(attributed) over (partition by suppkey order by year) prev from att)
 select suppkey, year, round(prev, 4) prev, round(max(prev - attributed) over (partition by suppkey order by year rows unbounded preceding), 4) worst_drop from p""",
)
def q38(t: Tables) -> DataFrame:
    return panel.previous(attribution(t), "suppkey", "year", "attributed").select("suppkey", "year", r("prev", 4).alias("prev"), r("worst_drop", 4).alias("worst_drop"))


@query(
    "q43_lagged_staleness",
    f"""with {PANEL}, c as (select a.suppkey, a.intensity x, b.intensity y from panel a join panel b on a.suppkey = b.suppkey and a.year = 1998 and b.year = 2000),
 k as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 ry from c where x is not null and y is not null)
 select count(*) n, round(case when count(*) >= 20 then corr(rx, ry) end, 6) spearman, round(case when count(*) >= 20 then median(abs(rx - ry)) end, 6) median_diff,
 round(case when count(*) >= 20 then quantile_cont(abs(rx - ry), 0.9) end, 6) p90_diff from k""",
)
def q43(t: Tables) -> DataFrame:
    base = company_year(t).where("intensity is not null").select("suppkey", "year", "intensity")
    both = base.where("year = 1998").select("suppkey", F.col("intensity").alias("x")).join(
        base.where("year = 2000").select("suppkey", F.col("intensity").alias("y")), "suppkey"
    )
    n = F.count(F.lit(1))
    ranked = both.withColumns({"rx": F.col("x"), "ry": F.col("y")})
    ranked = average_ranks(ranked, ["rx", "ry"]).withColumn("d", F.abs(F.col("rx") - F.col("ry")))
    ok = lambda c: r(F.when(n >= 20, c))
    return ranked.agg(
        n.alias("n"), ok(F.corr("rx", "ry")).alias("spearman"), ok(F.median("d")).alias("median_diff"), ok(F.percentile("d", F.lit(0.9))).alias("p90_diff")
    )


@query(
    "q72_owner_collapse",
    """with o as (select l_partkey partkey, year(l_shipdate)::bigint as year, l_suppkey suppkey, sum(1 - l_discount) s, max(1 - l_discount) conf, min(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end) ord from lineitem group by 1, 2, 3)
 select partkey, year, suppkey, round(least(1.0, s), 6) share, round(conf, 6) conf, case ord when 0 then 'exact' when 1 then 'override' else 'prefix' end as method from o""",
)
def q72(t: Tables) -> DataFrame:
    share = 1 - F.col("l_discount")
    order = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    grouped = t.lineitem.groupBy(
        F.col("l_partkey").alias("partkey"), F.year("l_shipdate").cast("bigint").alias("year"), F.col("l_suppkey").alias("suppkey")
    ).agg(F.sum(share).alias("s"), F.max(share).alias("conf"), F.min(order).alias("ord"))
    return grouped.select(
        "partkey", "year", "suppkey", r(F.least(F.lit(1.0), F.col("s"))).alias("share"), r("conf").alias("conf"),
        F.element_at(F.array(F.lit("exact"), F.lit("override"), F.lit("prefix")), F.col("ord") + 1).alias("method"),
    )


@query(
    "q85_group_demean_frames",
    f"""with {ATT} select suppkey, year, round(attributed - median(attributed) over (partition by year), 4) demeaned,
 round(sum(attributed) over (partition by suppkey order by year rows between 2 preceding and current row), 4) moving_sum from att""",
)
def q85(t: Tables) -> DataFrame:
    moving = Window.partitionBy("suppkey").orderBy("year").rowsBetween(-2, 0)
    return attribution(t).select(
        "suppkey", "year", r(F.col("attributed") - F.median("attributed").over(Window.partitionBy("year")), 4).alias("demeaned"),
        r(F.sum("attributed").over(moving), 4).alias("moving_sum"),
    )


@query(
    "q84_drift_and_leave_one_out",
    f"""with {PANEL}, d as (select suppkey, year, attributed, k replicate, attributed * exp(0.1 * (sqrt(-2 * ln(ua)) * cos(2 * pi() * ub))) drifted from
 (select *, (('0x' || substr(md5(concat_ws('|', k, suppkey, year, 'a')), 1, 13))::bigint + 0.5) / 4503599627370496.0 ua, (('0x' || substr(md5(concat_ws('|', k, suppkey, year, 'b')), 1, 13))::bigint + 0.5) / 4503599627370496.0 ub
 from panel cross join range(5) g(k) where year = 2000))
 select replicate, round(median(abs(drifted - attributed)), 4) median_diff, round(corr(drifted, attributed), 5) rho from d group by 1""",
)
def q84(t: Tables) -> DataFrame:
    from ledgerline.functions.columns import hash_normal

    one_year = company_year(t).where("year = 2000").withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))
    drifted = F.col("attributed") * F.exp(0.1 * hash_normal(F.col("replicate"), F.col("suppkey"), F.col("year")))
    return one_year.withColumn("drifted", drifted).groupBy("replicate").agg(
        r(F.median(F.abs(F.col("drifted") - F.col("attributed"))), 4).alias("median_diff"), r(F.corr("drifted", "attributed"), 5).alias("rho")
    )


def flagship(t: Tables) -> DataFrame:
    """Owners, shares, company years, revenue, intensity and its rank among the issuers of a sector."""
    full = q02(t)
    return full.withColumn("pct", r(100 * percentile_rank(positive(F.col("intensity")), [F.col("sector"), F.col("year")])))
