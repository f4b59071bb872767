"""Peers, normalised scores, weights and simulated bands over the customers' accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import principal_loadings, weighted_mean
from ledgerline.operators import methods, ranking, scoring
from ledgerline.sources.shared import spread, stored

from .base import Tables, query, r

ISSUERS = """iss as (select c_custkey as key, n_name sub, r_name sector, c_mktsegment segment, case when c_acctbal > 0 then c_acctbal end bal from customer
 join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
SPEND = "spend as (select o_custkey as key, sum(o_totalprice) spend, count(*)::double orders from orders group by 1)"
WIDE = f"{ISSUERS}, {SPEND}, wide as (select iss.*, spend, orders from iss left join spend using (key))"


def pct_sql(x: str, by: str) -> str:
    part = f"partition by {by}, {x}" if by else f"partition by {x}"
    whole = f"partition by {by}" if by else ""
    return f"case when {x} is not null then (rank() over ({whole} order by {x} nulls last) + (count(*) over ({part}) - 1) / 2.0) / count({x}) over ({whole}) end"


def issuers(t: Tables) -> DataFrame:
    named = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(
        F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return named.select(
        F.col("c_custkey").alias("key"), F.col("n_name").alias("sub"), F.col("r_name").alias("sector"), F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"),
    )


def wide(t: Tables) -> DataFrame:
    spend = t.orders.groupBy(F.col("o_custkey").alias("key")).agg(r(F.sum("o_totalprice")).alias("spend"), F.count(F.lit(1)).cast("double").alias("orders"))
    # Rounded: equal orders make equal sums, in whatever order they were added.
    return issuers(t).join(spend, "key", "left")


@query("q06_avg_pct_rank", f"with {ISSUERS} select key, sub peer, round({pct_sql('bal', 'sub')}, 6) pct from iss")
def q06(t: Tables) -> DataFrame:
    ranked = ranking.percentile_ranks(issuers(t), {"bal": "pct"}, ["sub"])
    return ranked.select("key", F.col("sub").alias("peer"), r("pct").alias("pct"))


@query(
    "q07_ordinal_pct",
    f"with {ISSUERS}, k as (select key, row_number() over (order by bal desc, key) as rank, row_number() over (order by bal, key) as up, count(*) over () n from iss where bal is not null) select key, rank, round(100.0 * (up - 1) / (n - 1), 6) pct0, round((up - 0.5) / n, 6) pct_mid from k",
)
def q07(t: Tables) -> DataFrame:
    down = ranking.row_numbers(issuers(t).select("key", "bal"), "bal", "key", "rank", descending=True).select("key", "rank")
    up = ranking.row_numbers(issuers(t).select("key", "bal"), "bal", "key", "up").select("key", "up")
    n = issuers(t).agg(F.count("bal").alias("n"))
    df = down.join(up, "key").crossJoin(F.broadcast(n))  # one row
    return df.select("key", "rank", r(100.0 * (F.col("up") - 1) / (F.col("n") - 1)).alias("pct0"), r((F.col("up") - 0.5) / F.col("n")).alias("pct_mid"))


@query(
    "q08_peer_fallback",
    f"""with {ISSUERS}, a as (select *, count(*) over (partition by sub, segment) n1, count(*) over (partition by sub) n2 from iss),
 b as (select key, case when n1 >= 12 then sub || '/' || segment when n2 >= 30 then sub else sector end peer_group from a)
 select key, peer_group, count(*) over (partition by peer_group) peer_n from b""",
)
def q08(t: Tables) -> DataFrame:
    n1 = F.count(F.lit(1)).over(Window.partitionBy("sub", "segment"))
    n2 = F.count(F.lit(1)).over(Window.partitionBy("sub"))
    peer = F.when(n1 >= 12, F.concat_ws("/", "sub", "segment")).when(n2 >= 30, F.col("sub")).otherwise(F.col("sector"))
    return issuers(t).select("key", peer.alias("peer_group")).withColumn("peer_n", F.count(F.lit(1)).over(Window.partitionBy("peer_group")))


def scaled_sql(z: str) -> str:
    return f"case when max({z}) over w > min({z}) over w then ({z} - min({z}) over w) / (max({z}) over w - min({z}) over w) else 0.5 end"


def rescaled_sql(z: str) -> str:
    return f"case when coalesce(max({z}) over w - min({z}) over w, 0) < 1e-12 then 0.5 else 0.01 + 0.99 * ({z} - min({z}) over w) / (max({z}) over w - min({z}) over w) end"


def clip_sql(z: str) -> str:
    return f"case when {z} is not null then greatest(-3.0, least(3.0, {z})) end"


WINSOR = "v as (select key, sector, case when bal is not null and count(bal) over w >= 5 then greatest(quantile_cont(bal, 0.05) over w, least(quantile_cont(bal, 0.95) over w, bal)) else bal end v from iss window w as (partition by sector))"
Z_SQL = "z as (select key, sector, case when stddev_pop(v) over w > 1e-12 then (v - avg(v) over w) / stddev_pop(v) over w else v * 0 end z from v window w as (partition by sector))"


@query("q09_winsor_z", f"with {ISSUERS}, {WINSOR}, {Z_SQL}, c as (select key, sector, {clip_sql('z')} z from z) select key, round({rescaled_sql('z')}, 6) score from c window w as (partition by sector)")
def q09(t: Tables) -> DataFrame:
    return scoring.winsor_z(issuers(t), "bal", ["sector"], "score").select("key", r("score").alias("score"))


@query("q10_minmax", f"with {ISSUERS}, {WINSOR} select key, round({rescaled_sql('v')}, 6) score from v window w as (partition by sector)")
def q10(t: Tables) -> DataFrame:
    return scoring.min_max(issuers(t), "bal", ["sector"], "score").select("key", r("score").alias("score"))


ROBUST = f"""m as (select *, median(bal) over (partition by sector) m from iss), d as (select *, median(abs(bal - m)) over (partition by sector) mad from m),
 rz as (select key, sector, {clip_sql('case when mad > 1e-12 then (bal - m) / (1.4826 * mad) else bal * 0 end')} z from d)"""


@query("q11_median_mad", f"with {ISSUERS}, {ROBUST} select key, round({rescaled_sql('z')}, 6) score from rz window w as (partition by sector)")
def q11(t: Tables) -> DataFrame:
    return scoring.median_mad(issuers(t), "bal", ["sector"], "score").select("key", r("score").alias("score"))


@query(
    "q12_phi_z",
    f"""with {ISSUERS}, {WINSOR}, s as (select key, (v - avg(v) over w) / nullif(stddev_pop(v) over w, 0) z from v window w as (partition by sector)),
 p as (select key, case when z >= 0 then 1 - u else u end p from (select *, 0.3989422804014327 * exp(-z * z / 2) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) u from (select *, 1 / (1 + 0.2316419 * abs(z)) t from s)))
 select key, round(coalesce(case when p is not null then greatest(0.01, least(1, p)) end, 0.5), 6) score from p""",
)
def q12(t: Tables) -> DataFrame:
    return scoring.phi_z(issuers(t), "bal", ["sector"], "score").select("key", r("score").alias("score"))


LOWER = f"""(select key, 'rank' normaliser, 0.01 + 0.99 * ({pct_sql('bal', 'sector')}) score from (select key, sector, -bal bal from iss) union all select key, 'winsor-z', {rescaled_sql('z')} from (select key, sector, {clip_sql('-z')} z from z) window w as (partition by sector)
 union all select key, 'min-max', {rescaled_sql('v')} from (select key, sector, -v v from v) window w as (partition by sector) union all select key, 'median-mad', {rescaled_sql('z')} from (select key, sector, -z z from rz) window w as (partition by sector))"""


@query("q97_lower_is_better", f"with {ISSUERS}, {WINSOR}, {Z_SQL}, {ROBUST} select key, normaliser, round(score, 6) score from {LOWER}")
def q97(t: Tables) -> DataFrame:
    """All registered normalisers with less being better."""
    out = None
    for name, normalise in scoring.NORMALISERS.items():
        df = normalise(issuers(t), "bal", ["sector"], "score", direction=-1).select("key", F.lit(name).alias("normaliser"), r("score").alias("score"))
        out = df if out is None else out.unionByName(df)
    return out


METRICS = ["bal", "spend", "orders"]
SCORED = f"{WIDE}, scored as (select key, sector, {', '.join(f'{pct_sql(m, chr(115) + "ector")} {m}' for m in METRICS)} from wide)"


def scored(t: Tables) -> DataFrame:
    ranked = ranking.percentile_ranks(wide(t).select("key", "sector", *METRICS), {m: f"{m}_pct" for m in METRICS}, ["sector"], sized_by=issuers(t))
    return ranked.select("key", "sector", *[F.col(f"{m}_pct").alias(m) for m in METRICS])


@query(
    "q13_entropy_weights",
    f"""with {SCORED}, l as (select key, unnest(['bal', 'spend', 'orders']) metric, unnest([bal, spend, orders]) s from scored),
 p as (select metric, case when s / sum(s) over (partition by metric) > 0 then s / sum(s) over (partition by metric) else 1e-12 end p from l), e as (select metric, 1 + sum(p * ln(p)) / ln(greatest(count(*), 2)) d from p group by 1)
 select metric, round(case when sum(d) over () <= 1e-12 then 1.0 / count(*) over () else d / sum(d) over () end, 6) weight from e""",
)
def q13(t: Tables) -> DataFrame:
    long = scored(t).unpivot(["key"], METRICS, "metric", "score").select("metric", "score")
    return scoring.entropy_weights(long).select("metric", r("weight").alias("weight"))


@query(
    "q14_critic_weights",
    f"""with {SCORED}, c as (select 'bal' metric, stddev_pop(bal) * (2 - coalesce(corr(bal, spend), 0) - coalesce(corr(bal, orders), 0)) c from scored union all select 'spend', stddev_pop(spend) * (2 - coalesce(corr(spend, bal), 0) - coalesce(corr(spend, orders), 0)) from scored
 union all select 'orders', stddev_pop(orders) * (2 - coalesce(corr(orders, bal), 0) - coalesce(corr(orders, spend), 0)) from scored) select metric, round(c / sum(c) over (), 6) weight from c""",
)
def q14(t: Tables) -> DataFrame:
    return scoring.critic_weights(scored(t), METRICS).select("metric", r("weight").alias("weight"))


FIXED = {"bal": 0.5, "spend": 0.3, "orders": 0.2}
ARITH = "(" + " + ".join(f"coalesce({w} * {m}, 0)" for m, w in FIXED.items()) + ") / nullif(" + " + ".join(f"case when {m} is not null then {w} else 0 end" for m, w in FIXED.items()) + ", 0)"
GEO = "exp((" + " + ".join(f"coalesce(case when {m} is not null then {w} * ln(greatest({m}, 1e-6)) end, 0)" for m, w in FIXED.items()) + ") / nullif(" + " + ".join(f"case when {m} is not null then {w} else 0 end" for m, w in FIXED.items()) + ", 0))"


@query("q15_geometric_aggregate", f"with {SCORED} select key, round(case when bal is null and spend is null and orders is null then null else {GEO} end, 6) score from scored")
def q15(t: Tables) -> DataFrame:
    return scored(t).select("key", r(weighted_mean([F.col(m) for m in FIXED], [F.lit(w) for w in FIXED.values()], geometric=True)).alias("score"))


@query("q16_arithmetic_aggregate", f"with {SCORED} select key, round({ARITH}, 6) score from scored")
def q16(t: Tables) -> DataFrame:
    return scored(t).select("key", r(weighted_mean([F.col(m) for m in FIXED], [F.lit(w) for w in FIXED.values()])).alias("score"))


@query("q17_score_once_fixed_draw", f"with {SCORED}, s as (select key, sector, {ARITH} score from scored) select key, sector peer, round(score, 6) score, round(100 * {pct_sql('score', 'sector')}, 4) percentile from (select key, sector, round(score, 9) score from s)")
def q17(t: Tables) -> DataFrame:
    score = weighted_mean([F.col(m) for m in FIXED], [F.lit(w) for w in FIXED.values()])
    df = scored(t).select("key", F.col("sector").alias("peer"), F.round(score, 9).alias("score"))
    df = ranking.percentile_ranks(df, {"score": "pct"}, ["peer"], sized_by=issuers(t).select(F.col("sector").alias("peer")))
    return df.select("key", "peer", r("score").alias("score"), r(100 * F.col("pct"), 4).alias("percentile"))


def uniform_sql(*key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 13))::bigint + 0.5) / 4503599627370496.0"


DRAWS = f"""{ISSUERS}, drawn as (select key, sector, draw, round(bal + sd * (0.05 + 0.35 * 0.5) * z, 6) x from (select key, sector, draw, bal, sd, sqrt(-2 * ln({uniform_sql('20260912', 'draw', 'key', "'a'")})) * cos(2 * pi() * {uniform_sql('20260912', 'draw', 'key', "'b'")}) z
 from (select *, stddev_pop(bal) over (partition by sector) sd from iss where bal is not null) cross join range(40) g(draw))), pct as (select key, sector, draw, 100 * {pct_sql('x', 'sector, draw')} pct from drawn)"""


def drawn(t: Tables, n: int = 40) -> DataFrame:
    """Issuers with a balance, as often as there are draws."""
    return spread(issuers(t).where("bal is not null").select("key", "sector", "bal")).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))


def draws(t: Tables, n: int = 40) -> DataFrame:
    """key, sector, draw, pct: percentile among the sector under n noise draws."""
    # One row a sector.
    spread = issuers(t).groupBy("sector").agg(F.stddev_pop("bal").alias("sd"))
    base = drawn(t, n).join(F.broadcast(spread), "sector")
    x = F.round(scoring.noisy(base, F.col("bal"), F.col("sd"), F.lit(0.5), F.lit(20260912), F.col("draw"), F.col("key")), 6)
    ranked = ranking.percentile_ranks(base.select("key", "sector", "draw", x.alias("x")), {"x": "pct"}, ["sector", "draw"], sized_by=base)
    return ranked.select("key", "sector", "draw", (100 * F.col("pct")).alias("pct"))


@query(
    "q18_monte_carlo_bands",
    f"""with {DRAWS}, b as (select key, quantile_cont(pct, 0.1) p10, quantile_cont(pct, 0.5) p50, quantile_cont(pct, 0.9) p90, avg((pct >= 80)::double) top_share, avg((pct <= 20)::double) bottom_share from pct group by 1)
 select key, round(p10, 4) p10, round(p50, 4) p50, round(p90, 4) p90, round(p90 - p10, 4) width, round(top_share, 6) top_share, round(bottom_share, 6) bottom_share from b""",
)
def q18(t: Tables) -> DataFrame:
    b = scoring.bands(draws(t), ["key"], "pct")
    return b.select("key", *[r(c, 4).alias(c) for c in ("p10", "p50", "p90", "width")], r("top_share").alias("top_share"), r("bottom_share").alias("bottom_share"))


@query(
    "q20_rank_bands",
    f"""with {DRAWS}, k as (select key, draw, row_number() over (partition by draw order by round(pct, 9) desc, key) as rk from pct), b as (select key, quantile_cont(rk, 0.05) a, quantile_cont(rk, 0.25) b, quantile_cont(rk, 0.5) c, quantile_cont(rk, 0.75) d, quantile_cont(rk, 0.95) e from k group by 1)
 select key, floor(round(a, 6))::bigint p05, floor(round(c, 6))::bigint p50, floor(round(e, 6))::bigint p95, round(d - b, 4) iqr, round(1 - (d - b) / max(e) over (), 6) stability from b""",
)
def q20(t: Tables) -> DataFrame:
    q = F.percentile("rk", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    df = draws(t).select("key", "draw", F.round("pct", 9).alias("pct"))
    b = ranking.group_row_numbers(df, "pct", "key", ["draw"], "rk", descending=True, sized_by=drawn(t)).groupBy("key").agg(q.alias("q"))
    at = lambda i: F.element_at("q", i)
    iqr = at(4) - at(2)
    b = b.crossJoin(F.broadcast(b.agg(F.max(at(5)).alias("most"))))  # one row
    return b.select(
        "key", F.floor(r(at(1))).alias("p05"), F.floor(r(at(3))).alias("p50"), F.floor(r(at(5))).alias("p95"), r(iqr, 4).alias("iqr"),
        r(1 - iqr / F.col("most")).alias("stability"),
    )


def design(t: Tables) -> DataFrame:
    """key, metric, peers, pct: ranks of three metrics under two peer levels."""
    long = wide(t).unpivot(["key", "sector", "sub"], METRICS, "metric", "x")
    levels = long.withColumn("peers", F.explode(F.array(F.lit("sector"), F.lit("sub"))))
    levels = levels.withColumn("peer", F.when(F.col("peers") == "sector", F.col("sector")).otherwise(F.col("sub")))
    ranked = ranking.percentile_ranks(levels, {"x": "pct"}, ["metric", "peers", "peer"])
    return ranked.withColumn("pct", 100 * F.col("pct")).where("pct is not null")


DESIGN = f"""{WIDE}, long as (select key, sector, sub, unnest(['bal', 'spend', 'orders']) metric, unnest([bal, spend, orders]) x from wide),
 lev as (select *, case when peers = 'sector' then sector else sub end peer from long cross join (select unnest(['sector', 'sub']) peers)), des as (select * from (select *, 100 * {pct_sql('x', 'metric, peers, peer')} pct from lev) where pct is not null)"""


@query(
    "q21_anova_effects",
    f"""with {DESIGN}, tot as (select avg(pct) m, var_pop(pct) v, count(*) n from des), e as (select 'metric' factor, avg(pct) m, count(*) n from des group by metric union all select 'peers', avg(pct), count(*) from des group by peers union all select 'sector', avg(pct), count(*) from des group by sector)
 select factor, round(sum(e.n * (e.m - tot.m) * (e.m - tot.m)) / max(tot.n) / max(tot.v), 8) first_order from e, tot group by 1""",
)
def q21(t: Tables) -> DataFrame:
    return scoring.main_effects(design(t), ["metric", "peers", "sector"], "pct").select("factor", r("first_order", 8).alias("first_order"))


@query(
    "q22_method_range",
    f"""with {DESIGN}, a as (select key, metric, max(pct) - min(pct) rg from des group by 1, 2), b as (select key, peers, max(pct) - min(pct) rg from des group by 1, 2)
 select 'peers' dimension, round(avg(rg), 6) mean_range from a union all select 'metric', round(avg(rg), 6) from b""",
)
def q22(t: Tables) -> DataFrame:
    df = design(t)
    spread = lambda other, name: (
        df.groupBy("key", other).agg((F.max("pct") - F.min("pct")).alias("rg")).agg(F.lit(name).alias("dimension"), r(F.avg("rg")).alias("mean_range"))
    )
    return spread("metric", "peers").unionByName(spread("peers", "metric"))


@query(
    "q44_spearman_matrix",
    f"""with {WIDE}, f as (select key, bal, spend, orders from wide where bal is not null and spend is not null), k as (select {', '.join(f'rank() over (order by {m}) + (count(*) over (partition by {m}) - 1) / 2.0 {m}' for m in METRICS)} from f)
 select 'bal' metric_a, 'spend' metric_b, round(corr(bal, spend), 6) rho from k union all select 'bal', 'orders', round(corr(bal, orders), 6) from k union all select 'spend', 'orders', round(corr(spend, orders), 6) from k""",
)
def q44(t: Tables) -> DataFrame:
    full = wide(t).where("bal is not null and spend is not null")
    ranked = ranking.average_ranks(full.select(*METRICS), METRICS)
    pairs = [("bal", "spend"), ("bal", "orders"), ("spend", "orders")]
    row = ranked.agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])
    entries = F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), r(f"{a}_{b}").alias("rho")) for a, b in pairs])
    return row.select(F.inline(entries))


@query(
    "q78_between_group_r2",
    f"with {ISSUERS}, f as (select bal, avg(bal) over (partition by sub) g, avg(bal) over () a from iss where bal is not null) select round(sum((g - a) * (g - a)) / sum((bal - a) * (bal - a)), 8) r2 from f",
)
def q78(t: Tables) -> DataFrame:
    f = issuers(t).where("bal is not null").groupBy("sub").agg(F.avg("bal").alias("g"), F.var_pop("bal").alias("v"), F.count(F.lit(1)).alias("n"))
    n, mean = F.sum("n"), F.sum(F.col("g") * F.col("n")) / F.sum("n")
    s = f.agg(n.alias("n"), mean.alias("a"), F.sum(F.col("n") * F.col("g") * F.col("g")).alias("gg"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("gg") - F.col("n") * F.col("a") * F.col("a")
    return s.select(r(between / (between + F.col("within")), 8).alias("r2"))


AXIS = ["winsor", "minmax", "rank"]
AXIS_SQL = f"""{WIDE}, long as (select key, sector, unnest(['bal', 'spend', 'orders']) metric, unnest([bal, spend, orders]) x from wide), dev as (select metric, stddev_pop(x) sd from long group by 1),
 noised as (select key, sector, metric, draw, round(x + sd * (0.05 + 0.35 * 0.5) * sqrt(-2 * ln({uniform_sql('20260912', 'draw', 'key', 'metric', "'a'")})) * cos(2 * pi() * {uniform_sql('20260912', 'draw', 'key', 'metric', "'b'")}), 6) x
 from long join dev using (metric) cross join range(20) g(draw) where x is not null),
 av as (select *, case when count(x) over w >= 5 then greatest(quantile_cont(x, 0.05) over w, least(quantile_cont(x, 0.95) over w, x)) else x end v from noised window w as (partition by metric, draw, sector)),
 az as (select *, case when stddev_pop(v) over w > 1e-12 then (v - avg(v) over w) / stddev_pop(v) over w else v * 0 end z from av window w as (partition by metric, draw, sector)),
 an as (select key, draw, unnest(['winsor', 'minmax', 'rank']) normaliser, unnest([{rescaled_sql('c')}, {rescaled_sql('v')}, 0.01 + 0.99 * ({pct_sql('x', 'metric, draw, sector')})]) s from (select *, {clip_sql('z')} c from az) window w as (partition by metric, draw, sector)),
 am as (select key, draw, normaliser, round(avg(s), 9) score from an group by 1, 2, 3), ap as (select key, draw, normaliser, 100 * {pct_sql('score', 'draw, normaliser')} pct from am)"""


@query(
    "q81_axis_bands",
    f"with {AXIS_SQL} select key, count(*) runs, round(median(pct), 4) median, round(quantile_cont(pct, 0.1), 4) p10, round(quantile_cont(pct, 0.9), 4) p90 from ap group by 1",
)
def q81(t: Tables) -> DataFrame:
    """Bands of an axis: three normalisers by 20 draws of the same noise, the mean over the axis's metrics, percentiles over all."""
    long = wide(t).unpivot(["key", "sector"], METRICS, "metric", "x")
    dev = long.groupBy("metric").agg(F.stddev_pop("x").alias("sd"))
    df = spread(long.where("x is not null").join(F.broadcast(dev), "metric")).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))))
    df = df.withColumn("x", F.round(scoring.noisy(df, F.col("x"), F.col("sd"), F.lit(0.5), F.lit(20260912), F.col("draw"), F.col("key"), F.col("metric")), 6))
    group = ["metric", "draw", "sector"]
    df = stored(df.select("key", *group, "x"), "axis-draws")
    df = scoring.winsor_scores(df, "x", group, "winsor", "minmax")
    df = scoring.rank_score(df, "x", group, "rank").select("key", "draw", *AXIS)
    means = df.groupBy("key", "draw").agg(*[F.round(F.avg(m), 9).alias(m) for m in AXIS]).unpivot(["key", "draw"], AXIS, "normaliser", "score")
    sized = issuers(t).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))).alias("draw")).select("draw", F.explode(F.array(*map(F.lit, AXIS))).alias("normaliser"))
    pct = ranking.percentile_ranks(means, {"score": "pct"}, ["draw", "normaliser"], sized_by=sized).withColumn("pct", 100 * F.col("pct"))
    b = scoring.bands(pct, ["key"], "pct")
    return b.select("key", "runs", r("p50", 4).alias("median"), r("p10", 4).alias("p10"), r("p90", 4).alias("p90"))


PROFILES = {"equal": (1 / 3, 1 / 3, 1 / 3), "wealth": (0.6, 0.2, 0.2), "volume": (0.2, 0.6, 0.2), "activity": (0.2, 0.2, 0.6)}
PROFILE_SQL = " union all ".join(
    f"select '{p}' profile, key, round(({' + '.join(f'coalesce({w!r} * {m}, 0)' for m, w in zip(METRICS, ws))}) / nullif({' + '.join(f'case when {m} is not null then {w!r} else 0 end' for m, w in zip(METRICS, ws))}, 0), 9) score from scored" for p, ws in PROFILES.items()
)


@query("q82_axis_weight_profiles", f"with {SCORED}, s as ({PROFILE_SQL}) select profile, key, round(score, 6) score, round(100 * {pct_sql('score', 'profile')}, 4) percentile from s")
def q82(t: Tables) -> DataFrame:
    profile = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), *[F.lit(w).alias(f"w_{m}") for m, w in zip(METRICS, ws, strict=True)]) for p, ws in PROFILES.items()]))
    df = scored(t).withColumn("p", profile)
    score = F.round(weighted_mean([F.col(m) for m in METRICS], [F.col(f"p.w_{m}") for m in METRICS]), 9)
    df = df.select(F.col("p.profile").alias("profile"), "key", score.alias("score"))
    df = ranking.percentile_ranks(df, {"score": "pct"}, ["profile"], sized_by=issuers(t).select(profile.alias("p")).select("p.profile"))
    return df.select("profile", "key", r("score").alias("score"), r(100 * F.col("pct"), 4).alias("percentile"))


@query(
    "q75_group_transform_impute",
    f"""with {ISSUERS}, m as (select *, median(bal) over (partition by sub) gm, stddev_samp(bal) over (partition by sub) sd from iss), g as (select median(bal) am from iss)
 select key, round(coalesce(bal, gm, am), 4) value, round(case when bal is null then greatest(coalesce(sd, 0), 1e-6) else 1e-6 end, 6) se, bal is null imputed from m, g""",
)
def q75(t: Tables) -> DataFrame:
    whole = issuers(t).agg(F.median("bal").alias("am"))
    by_sub = issuers(t).groupBy("sub").agg(F.median("bal").alias("gm"), F.stddev_samp("bal").alias("sd"))  # a row a sub-sector
    df = issuers(t).join(F.broadcast(by_sub), "sub").crossJoin(F.broadcast(whole))  # one row
    missing = F.col("bal").isNull()
    se = F.when(missing, F.greatest(F.coalesce("sd", F.lit(0.0)), F.lit(1e-6))).otherwise(1e-6)
    return df.select("key", r(F.coalesce("bal", "gm", "am"), 4).alias("value"), r(se).alias("se"), missing.alias("imputed"))


@query(
    "q64_histogram_bins",
    "with b as (select floor(c_acctbal / 1000)::bigint b, count(*) n from customer group by 1), s as (select unnest(range(-2, 12)) b) select s.b * 1000 bin_lo, coalesce(n, 0) n from s left join b using (b)",
)
def q64(t: Tables) -> DataFrame:
    counts = t.customer.groupBy(F.floor(F.col("c_acctbal") / 1000).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    bins = t.spark.range(-2, 12).withColumnRenamed("id", "b")
    return bins.join(counts, "b", "left").select((F.col("b") * 1000).alias("bin_lo"), F.coalesce("n", F.lit(0)).alias("n"))


def draw_matrix(t: Tables) -> DataFrame:
    """Every key and draw with its percentile and the draw's factors."""
    factors = t.spark.range(40).select(
        F.col("id").alias("draw"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("parity"), F.lit("rank").alias("normaliser")
    )
    return draws(t).join(F.broadcast(factors), "draw").select("draw", "key", r("pct", 4).alias("percentile"), "parity", "normaliser")


@query(
    "q94_draw_matrix_whole",
    f"""with {DRAWS}, f as (select draw, case when draw % 2 = 0 then 'even' else 'odd' end parity, 'rank' as normaliser from (select distinct draw from pct))
 select draw, key, round(pct, 4) percentile, parity, normaliser from pct join f using (draw)""",
)
def q94(t: Tables) -> DataFrame:
    return draw_matrix(t)


GRID = ["normaliser", "aggregation", "peers", "draw"]
GRID_SQL = f"""{WIDE}, long as (select key, sector, sub, unnest(['bal', 'spend', 'orders']) metric, unnest([bal, spend, orders]) x from wide), dev as (select metric, stddev_pop(x) sd from long group by 1),
 noised as (select key, sector, sub, metric, draw, round(x + sd * (0.05 + 0.35 * 0.5) * sqrt(-2 * ln({uniform_sql('20260912', 'draw', 'key', 'metric', "'a'")})) * cos(2 * pi() * {uniform_sql('20260912', 'draw', 'key', 'metric', "'b'")}), 6) x
 from long join dev using (metric) cross join range(4) g(draw) where x is not null),
 levels as (select *, case when peers = 'sector' then sector else sub end peer from noised cross join (select unnest(['sector', 'sub']) peers)),
 valued as (select *, {pct_sql('x', 'metric, draw, peers, peer')} ranked, {scaled_sql('x')} scaled from levels window w as (partition by metric, draw, peers, peer)),
 normed as (select key, draw, peers, metric, case metric when 'bal' then 0.5 when 'spend' then 0.3 else 0.2 end::double wt, unnest(['rank', 'minmax']) normaliser, unnest([ranked, scaled]) v from valued),
 means as (select key, draw, peers, normaliser, sum(wt * v) / sum(wt) a, exp(sum(wt * ln(greatest(v, 1e-6))) / sum(wt)) g from normed group by 1, 2, 3, 4),
 scores as (select key, draw, peers, normaliser, unnest(['arith', 'geo']) aggregation, unnest([round(a, 9), round(g, 9)]) score from means), grid as (select *, 100 * {pct_sql('score', 'draw, peers, normaliser, aggregation')} pct from scores)"""


LEVELS = {"normaliser": ["rank", "minmax"], "aggregation": ["arith", "geo"], "peers": ["sector", "sub"], "imputation": ["global", "peer"]}


def _cells(t: Tables, factors: list[str], n: int) -> DataFrame:
    """Every customer in every cell of a design: what its groups have at most."""
    df = t.customer.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("draw"))
    for f in factors:
        if f != "draw":
            df = df.withColumn(f, F.explode(F.array(*map(F.lit, LEVELS[f]))))
    return df


def grid(t: Tables, n: int = 4) -> DataFrame:
    """key, GRID and pct: the percentile of every customer under a full factorial of methods and noise draws."""
    long = wide(t).unpivot(["key", "sector", "sub"], METRICS, "metric", "x")
    dev = long.groupBy("metric").agg(F.stddev_pop("x").alias("sd"))
    df = spread(long.where("x is not null").join(F.broadcast(dev), "metric")).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    df = df.withColumn("x", F.round(scoring.noisy(df, F.col("x"), F.col("sd"), F.lit(0.5), F.lit(20260912), F.col("draw"), F.col("key"), F.col("metric")), 6))
    df = stored(df.select("key", "sector", "sub", "metric", "draw", "x"), "grid-draws")
    df = df.withColumn("peers", F.explode(F.array(F.lit("sector"), F.lit("sub")))).withColumn("peer", F.when(F.col("peers") == "sector", F.col("sector")).otherwise(F.col("sub")))
    group = ["metric", "draw", "peers", "peer"]
    # One row for each group, by partial sums.
    bounds = df.groupBy(*group).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    df = ranking.percentile_ranks(df, {"x": "ranked"}, group).join(F.broadcast(bounds), group)
    scaled = F.when(F.col("high") > F.col("low"), (F.col("x") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)
    pair = lambda a, b, x, y, name: F.inline(F.array(F.struct(F.lit(a).alias(name), x.alias("v")), F.struct(F.lit(b).alias(name), y.alias("v"))))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in FIXED.items() for x in kv]), F.col("metric"))
    normed = df.select("key", "draw", "peers", weight.alias("wt"), pair("rank", "minmax", F.col("ranked"), scaled, "normaliser"))
    means = normed.groupBy("key", "draw", "peers", "normaliser").agg(
        (F.sum(F.col("wt") * F.col("v")) / F.sum("wt")).alias("a"), F.exp(F.sum(F.col("wt") * F.log(F.greatest("v", F.lit(1e-6)))) / F.sum("wt")).alias("g")
    )
    scores = means.select("key", "draw", "peers", "normaliser", pair("arith", "geo", F.round("a", 9), F.round("g", 9), "aggregation"))
    ranked = ranking.percentile_ranks(scores, {"v": "pct"}, GRID, sized_by=_cells(t, GRID, n))
    return ranked.select("key", *GRID, (100 * F.col("pct")).alias("pct"))


@query(
    "q95_factorial_effects",
    f"with {GRID_SQL}, c as (select *, pct - avg(pct) over (partition by key) y, count(*) over (partition by key) n from grid), "
    + ", ".join(
        f"{name}_{f} as (select sum(s) e from (select sum(y) * sum(y) / count(*) / max(n) s from c group by {', '.join(['key', *by])}))"
        for f in GRID for name, by in (("one", [f]), ("rest", [x for x in GRID if x != f]))
    )
    + ", tot as (select sum(y * y / n) v from c), e as (" + " union all ".join(f"select '{f}' factor, greatest(0, least(1, one_{f}.e / v)) f1, greatest(0, least(1, 1 - rest_{f}.e / v)) total from one_{f}, rest_{f}, tot" for f in GRID)
    + ") select factor, round(f1, 8) first_order, round(total, 8) total, round(f1 / sum(f1) over (), 8) share from e",
)
def q95(t: Tables) -> DataFrame:
    found = scoring.factorial_effects(grid(t), "key", GRID, "pct")
    return found.select("factor", *[r(c, 8).alias(c) for c in ("first_order", "total", "share")])


DESIGNED = ["imputation", "normaliser", "aggregation", "peers", "draw"]
DESIGNED_SQL = f"""{WIDE}, long as (select key, sector, sub, unnest(['bal', 'spend', 'orders']) metric, unnest([bal, spend, orders]) x from wide), dev as (select metric, stddev_pop(x) sd from long group by 1),
 noised as (select key, sector, sub, metric, draw, round(x + sd * (0.05 + 0.35 * 0.5) * sqrt(-2 * ln({uniform_sql('20260912', 'draw', 'key', 'metric', "'a'")})) * cos(2 * pi() * {uniform_sql('20260912', 'draw', 'key', 'metric', "'b'")}), 6) x from long join dev using (metric) cross join range(2) g(draw)),
 levels as (select *, case when peers = 'sector' then sector else sub end peer from noised cross join (select unnest(['sector', 'sub']) peers)),
 meds as (select *, median(x) over (partition by metric, draw, peers, peer) by_peer, median(x) over (partition by metric, draw, peers) by_all from levels),
 filled as (select key, metric, draw, peers, peer, unnest(['drop', 'global', 'peer']) imputation, unnest([coalesce(x, by_peer), coalesce(x, by_all), coalesce(x, by_peer)]) x from meds),
 valued as (select *, {pct_sql('x', 'metric, draw, peers, peer, imputation')} ranked, {scaled_sql('x')} scaled from filled where x is not null window w as (partition by metric, draw, peers, peer, imputation)),
 normed as (select key, draw, peers, imputation, metric, case metric when 'bal' then 0.5 when 'spend' then 0.3 else 0.2 end::double wt, unnest(['rank', 'minmax']) normaliser, unnest([ranked, scaled]) v from valued),
 means as (select key, draw, peers, imputation, normaliser, sum(wt * v) / sum(wt) a, exp(sum(wt * ln(greatest(v, 1e-6))) / sum(wt)) g from normed group by 1, 2, 3, 4, 5),
 scores as (select key, draw, peers, imputation, normaliser, unnest(['arith', 'geo']) aggregation, unnest([round(a, 9), round(g, 9)]) score from means), designed as (select *, 100 * {pct_sql('score', 'draw, peers, imputation, normaliser, aggregation')} pct from scores)"""


def designed(t: Tables, n: int = 2) -> DataFrame:
    """key, DESIGNED and pct: percentiles of all customers under methods that also fill missing metrics: by the median of the peers
    (as does drop, which leaves a filled cell neutral) or by that of all, of the same draw.  Medians come from selection."""
    long = wide(t).unpivot(["key", "sector", "sub"], METRICS, "metric", "x")
    dev = long.groupBy("metric").agg(F.stddev_pop("x").alias("sd"))
    df = spread(long.join(F.broadcast(dev), "metric")).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    df = df.withColumn("x", F.round(scoring.noisy(df, F.col("x"), F.col("sd"), F.lit(0.5), F.lit(20260912), F.col("draw"), F.col("key"), F.col("metric")), 6))
    df = stored(df.select("key", "sector", "sub", "metric", "draw", "x"), "design-draws")
    every = ranking.group_quantiles(df, "x", ["metric", "draw"], [0.5], "by_all").select("metric", "draw", F.element_at("by_all", 1).alias("by_all"))
    df = df.withColumn("peers", F.explode(F.array(F.lit("sector"), F.lit("sub")))).withColumn("peer", F.when(F.col("peers") == "sector", F.col("sector")).otherwise(F.col("sub")))
    cell = ["metric", "draw", "peers"]
    medians = ranking.group_quantiles(df, "x", [*cell, "peer"], [0.5], "by_peer").select(*cell, "peer", F.element_at("by_peer", 1).alias("by_peer"))
    # One row for each metric, draw and peer group.
    fills = F.array(*[F.struct(F.lit(name).alias("imputation"), F.coalesce("x", fill).alias("x")) for name, fill in (("global", "by_all"), ("peer", "by_peer"))])
    df = df.join(F.broadcast(medians), [*cell, "peer"], "left").join(F.broadcast(every), ["metric", "draw"], "left").select("key", *cell, "peer", F.inline(fills)).where("x is not null")
    group = ["metric", "draw", "peers", "peer", "imputation"]
    bounds = df.groupBy(*group).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    df = ranking.percentile_ranks(df, {"x": "ranked"}, group).join(F.broadcast(bounds), group)
    scaled = F.when(F.col("high") > F.col("low"), (F.col("x") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)
    pair = lambda a, b, x, y, name: F.inline(F.array(F.struct(F.lit(a).alias(name), x.alias("v")), F.struct(F.lit(b).alias(name), y.alias("v"))))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in FIXED.items() for x in kv]), F.col("metric"))
    own = ["key", "draw", "peers", "imputation"]
    normed = df.select(*own, weight.alias("wt"), pair("rank", "minmax", F.col("ranked"), scaled, "normaliser"))
    means = normed.groupBy(*own, "normaliser").agg(
        (F.sum(F.col("wt") * F.col("v")) / F.sum("wt")).alias("a"), F.exp(F.sum(F.col("wt") * F.log(F.greatest("v", F.lit(1e-6)))) / F.sum("wt")).alias("g")
    )
    scores = means.select(*own, "normaliser", pair("arith", "geo", F.round("a", 9), F.round("g", 9), "aggregation"))
    ranked = ranking.percentile_ranks(scores, {"v": "pct"}, DESIGNED, sized_by=_cells(t, ["draw", "peers", "imputation", "normaliser", "aggregation"], n))
    # Both fills by peers give the same cells.
    both = F.explode(F.when(F.col("imputation") == "peer", F.array(F.lit("drop"), F.lit("peer"))).otherwise(F.array("imputation")))
    return ranked.withColumn("imputation", both).select("key", *DESIGNED, (100 * F.col("pct")).alias("pct"))


SPACE = DESIGNED[:-1]


@query(
    "q19_factorial_config_space",
    f"with {DESIGNED_SQL}, m as (select {', '.join(SPACE)}, key, round(avg(pct), 6) pct from designed group by all), f as (select {', '.join(SPACE)}, count(*) n, arg_max(key, (pct, -key)) top_key, max(pct) top_pct from m group by all)"
    f" select row_number() over (order by {', '.join(SPACE)}) - 1 config_id, {', '.join(SPACE)}, n, top_key, top_pct from f",
)
def q19(t: Tables) -> DataFrame:
    """Every configuration of the design with the customers that it scores and its best one, over the draws."""
    means = designed(t).groupBy(*SPACE, "key").agg(r(F.avg("pct")).alias("pct"))
    found = means.groupBy(*SPACE).agg(F.count(F.lit(1)).alias("n"), F.max_by("key", F.struct("pct", -F.col("key"))).alias("top_key"), F.max("pct").alias("top_pct"))
    # The design's own size: a few dozen rows, whatever the data.
    return found.select((F.row_number().over(Window.orderBy(*SPACE)) - 1).cast("bigint").alias("config_id"), *SPACE, "n", "top_key", "top_pct")


@query(
    "q110_imputation_effects",
    f"with {DESIGNED_SQL}, c as (select *, pct - avg(pct) over (partition by key) y, count(*) over (partition by key) n from designed), "
    + ", ".join(
        f"{name}_{f} as (select sum(s) e from (select sum(y) * sum(y) / count(*) / max(n) s from c group by {', '.join(['key', *by])}))"
        for f in DESIGNED for name, by in (("one", [f]), ("rest", [x for x in DESIGNED if x != f]))
    )
    + ", tot as (select sum(y * y / n) v from c), e as (" + " union all ".join(f"select '{f}' factor, greatest(0, least(1, one_{f}.e / v)) f1, greatest(0, least(1, 1 - rest_{f}.e / v)) total from one_{f}, rest_{f}, tot" for f in DESIGNED)
    + ") select factor, round(f1, 8) first_order, round(total, 8) total, round(f1 / sum(f1) over (), 8) share from e",
)
def q110(t: Tables) -> DataFrame:
    found = scoring.factorial_effects(designed(t), "key", DESIGNED, "pct")
    return found.select("factor", *[r(c, 8).alias(c) for c in ("first_order", "total", "share")])


PCA_CELLS = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
PCA_SQL = ", ".join(f"covar_pop({METRICS[i]}, {METRICS[j]}) m{i}{j}" for i, j in PCA_CELLS)
PCA_STEP = ", ".join(" + ".join(f"m{min(i, k)}{max(i, k)} * m{min(k, j)}{max(k, j)}" for k in range(3)) + f" p{i}{j}" for i, j in PCA_CELLS)
PCA_LARGEST = "greatest(" + ", ".join(f"abs(p{i}{j})" for i, j in PCA_CELLS) + ")"


@query(
    "q111_principal_weights",
    f"""with recursive {SCORED}, filled as (select sector, {', '.join(f'coalesce({m}, avg({m}) over (partition by sector)) {m}' for m in METRICS)} from scored), s as (select sector, 0 i, {PCA_SQL} from filled group by 1),
 it as (select * from s union all select sector, i + 1, {', '.join(f'p{i}{j} / {PCA_LARGEST}' for i, j in PCA_CELLS)} from (select sector, i, {PCA_STEP} from it where i < 40)),
 v as (select sector, case when m00 >= m11 and m00 >= m22 then [m00, m01, m02] when m11 >= m22 then [m01, m11, m12] else [m02, m12, m22] end v from it where i = 40)
 select sector, unnest(['bal', 'spend', 'orders']) metric, round(unnest(list_transform(v, lambda x: abs(x) / list_sum(list_transform(v, lambda y: abs(y))))), 6) weight from v""",
)
def q111(t: Tables) -> DataFrame:
    """Weights of a sector's scored metrics by their first principal component: one aggregation of covariances, the rest on columns."""
    rows = scored(t)
    means = rows.groupBy("sector").agg(*[F.avg(m).alias(f"_{m}") for m in METRICS])
    filled = rows.join(F.broadcast(means), "sector").select("sector", *[F.coalesce(m, f"_{m}").alias(m) for m in METRICS])  # a row a sector
    cov = filled.groupBy("sector").agg(*[F.covar_pop(METRICS[i], METRICS[j]).alias(f"m{i}{j}") for i, j in PCA_CELLS])
    matrix = F.array(*[F.array(*[F.col(f"m{min(i, j)}{max(i, j)}") for j in range(3)]) for i in range(3)])
    loads = principal_loadings(matrix)
    return cov.select("sector", F.inline(F.arrays_zip(F.array(*map(F.lit, METRICS)).alias("metric"), loads.alias("weight")))).toDF("sector", "metric", "weight").withColumn("weight", r("weight"))


@query("q96_method_bands")
def q96(t: Tables) -> DataFrame:
    """Bands of drawn methods with noise, of methods alone and of noise alone."""
    drawn = methods.sample_draws(t.spark, 40, 20260912, METRICS)
    pct = methods.percentiles(wide(t).select("key", "sector", "sub", *METRICS), METRICS, drawn, 20260912).where("pct is not null")
    b = scoring.bands(pct, ["kind", "key"], "pct")
    return b.select("kind", "key", *[r(c, 4).alias(c) for c in ("p10", "p50", "p90", "width")], r("top_share").alias("top_share"), r("bottom_share").alias("bottom_share"))


def _without(m: str) -> dict[str, float]:
    return {k: w for k, w in FIXED.items() if k != m}


def mean_sql(weights: dict[str, float]) -> str:
    return "round((" + " + ".join(f"coalesce({w} * {k}, 0)" for k, w in weights.items()) + ") / nullif(" + " + ".join(f"case when {k} is not null then {w} else 0 end" for k, w in weights.items()) + ", 0), 9)"


@query(
    "q93_leave_one_out",
    f"with {SCORED}, s as (select {mean_sql(FIXED)} whole, {', '.join(f'{mean_sql(_without(m))} no_{m}' for m in METRICS)} from scored), f as (select * from s where whole is not null and {' and '.join(f'no_{m} is not null' for m in METRICS)}),"
    f" k as (select {', '.join(f'rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 {c}' for c in ['whole', *[f'no_{m}' for m in METRICS]])} from f) "
    + " union all ".join(f"select '{m}' left_out, round(corr(whole, no_{m}), 6) rho from k" for m in METRICS),
)
def q93(t: Tables) -> DataFrame:
    """Rank correlation of the score with the score that leaves one metric out."""
    mean = lambda ws: F.round(weighted_mean([F.col(k) for k in ws], [F.lit(w) for w in ws.values()]), 9)
    names = ["whole", *[f"no_{m}" for m in METRICS]]
    df = scored(t).select(mean(FIXED).alias("whole"), *[mean(_without(m)).alias(f"no_{m}") for m in METRICS]).dropna()
    row = ranking.average_ranks(df, names).agg(*[F.corr("whole", f"no_{m}").alias(m) for m in METRICS])
    return row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("left_out"), r(m).alias("rho")) for m in METRICS])))
