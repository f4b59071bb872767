"""Typed scans of the raw files of the domain: facilities, workplaces, enforcement, filings, ratings.

Each reads one folder or file, keeps its declared columns, coerces text to numbers (what
isn't one becomes missing) and does what must happen before anything is joined: choice
among repeated rows, unit conversion, sums a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.columns import positive, safe_div
from ledgerline.operators.dedupe import keep_first

from .files import archive, binary_sheets, binary_workbook, number, workbook
from .tables import header_name, register

#: Units.
SHORT_TON, GRAMS_A_POUND = 0.90718474, 453.592
#: Sectors that emit directly, and the code of biogenic gas.
DIRECT_SECTORS, BIOGENIC = (2, 3, 4, 5, 6, 7, 8, 14, 15), 8


#: Concepts of revenue, the first that a company year has wins.
REVENUE_CONCEPTS = [
    "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet",
    "RevenuesNetOfInterestExpense",
]


def _csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV file as text columns, whatever its own types look like."""
    return spark.read.options(header=True, inferSchema=False, mode="PERMISSIVE", **options).csv(path)


def _ticker(name: str) -> Column:
    return F.replace(F.trim(name), F.lit("."), F.lit("-"))


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def _optional(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; those that a release lacks are missing."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


@register("facilities")
def facilities(spark: SparkSession, path: str) -> DataFrame:
    keep = "facility_id year facility_name parent_company naics_code state city facility_types cems_used frs_id".split()
    df = _optional(_lower(_csv(spark, path)), keep).withColumns({"facility_id": number("facility_id", "bigint"), "year": number("year", "int")})
    return keep_first(df, ["facility_id", "year"], [F.col(c).asc_nulls_last() for c in keep[2:]])


@register("facility_emissions")
def facility_emissions(spark: SparkSession, path: str) -> DataFrame:
    """facility_id, year, scope1_t, biogenic_t, supplied_t in one pass over distinct rows: of facility years that emit
    directly other gas than biogenic (only these have a biogenic amount) or supply."""
    raw = _lower(_csv(spark, path))
    df = raw.select(*[number(c, "bigint") for c in ("facility_id", "year", "sector_id", "subsector_id", "gas_id")], number("co2e_emission"))
    df = keep_first(df, ["facility_id", "year", "sector_id", "subsector_id", "gas_id"], [F.desc_nulls_last("co2e_emission")])
    direct, biogenic = F.coalesce(F.col("sector_id").isin(*DIRECT_SECTORS), F.lit(False)), F.coalesce(F.col("gas_id") == BIOGENIC, F.lit(False))
    part = lambda where: F.coalesce(F.sum(F.when(where, F.col("co2e_emission"))), F.lit(0.0))
    rows = lambda where: F.count(F.when(where, 1))
    sums = df.groupBy("facility_id", "year").agg(
        part(direct & ~biogenic).alias("scope1_t"), part(direct & biogenic).alias("biogenic_t"), part(~direct).alias("supplied_t"),
        rows(direct & ~biogenic).alias("emits"), rows(~direct).alias("supplies"),
    )
    told = sums.where("emits > 0 or supplies > 0").withColumn("biogenic_t", F.when(F.col("emits") > 0, F.col("biogenic_t")).otherwise(0.0))
    return told.drop("emits", "supplies")


@register("unit_emissions")
def unit_emissions(spark: SparkSession, path: str) -> DataFrame:
    """Hourly-monitored units (JSON) summed to facility years, short tons to tonnes."""
    raw = spark.read.schema("facilityId bigint, year int, facilityName string, stateCode string, unitId string, co2Mass double, grossLoad double").json(path)
    return raw.groupBy("facilityId", "year").agg(
        F.min("facilityName").alias("facility_name"), F.min("stateCode").alias("state"), (F.sum("co2Mass") * SHORT_TON).alias("co2_t"),
        F.sum("grossLoad").alias("gross_load_mwh"), F.countDistinct("unitId").alias("n_units"),
    )


@register("unit_facilities")
def unit_facilities(spark: SparkSession, path: str) -> DataFrame:
    names = ["facilityName", "ownerOperator", "sourceCategory", "primaryFuelInfo", "stateCode", "operatingStatus", "programCodeInfo"]
    raw = spark.read.schema("facilityId bigint, year int, " + ", ".join(f"{n} string" for n in names)).json(path)
    return keep_first(raw, ["facilityId", "year"], [F.col(n).asc_nulls_last() for n in names])


@register("power_plants")
def power_plants(spark: SparkSession, path: str) -> DataFrame:
    """A metric workbook's sheet PLNT..., one row above the header; the year stands in the file's name."""
    # The workbook's codes and what they are called here, in the source's order.
    codes = {"ORISPL": "oris_code", "PNAME": "plant_name", "PSTATABB": "state", "OPRNAME": "operator_name", "UTLSRVNM": "utility_name", "PLPRMFL": "primary_fuel",
             "PLNGENAN": "net_generation_mwh", "PLCO2AN": "co2_t", "PLCO2RTA": "co2_kg_per_mwh", "NAMEPCAP": "capacity_mw"}
    raw = workbook(spark, path, "PLNT", list(codes), skip=1)
    df = raw.select(*[F.col(k).alias(v) for k, v in codes.items()], F.regexp_extract("file", r"(20\d\d)", 1).cast("int").alias("year"))
    numbers = {c: number(c) for c in ("net_generation_mwh", "co2_t", "co2_kg_per_mwh", "capacity_mw")}
    return df.withColumns({"oris_code": number("oris_code", "bigint"), **numbers}).where("net_generation_mwh is not null")


@register("plant_fuel")
def plant_fuel(spark: SparkSession, path: str) -> DataFrame:
    """Pages of JSON; only the totals over fuels and movers (in either case); a missing state or name is a group of its own."""
    fields = "plantCode bigint, plantName string, period string, state string, fuel2002 string, primeMover string, generation string, `total-consumption-btu` string"
    raw = spark.read.schema(fields).json(path).where("upper(fuel2002) = 'ALL' and upper(primeMover) = 'ALL'")
    amount = lambda c: F.coalesce(F.sum(F.expr(f"try_cast(`{c}` as double)")), F.lit(0.0))
    return raw.groupBy("plantCode", "plantName", "state", F.expr("try_cast(period as int)").alias("year")).agg(
        amount("generation").alias("generation_mwh"), amount("total-consumption-btu").alias("consumption_mmbtu")
    )


@register("plant_generation")
def plant_generation(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.parquet(path)
    summed = raw.groupBy("plant_id", F.year("report_date").alias("year")).agg(F.sum("net_generation_mwh").alias("net_generation_mwh"))
    return summed.where("net_generation_mwh > 0")


@register("plant_crosswalk")
def plant_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path).select(number("EPA_FACILITY_ID", "bigint"), number("EIA_PLANT_ID", "bigint"))
    return df.toDF("epa_id", "eia_id").dropna().distinct()


@register("releases")
def releases(spark: SparkSession, path: str) -> DataFrame:
    """Chemical releases with all their columns: headers like "12. FOO BAR/BAZ" become foo_bar_baz; the year is the release's, in the file's name."""
    raw = _csv(spark, path, encoding="ISO-8859-1")
    df = raw.toDF(*[header_name(c) for c in raw.columns])
    year = F.regexp_extract(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1), r"(20\d\d)", 1)
    own = F.expr("try_cast(trim(`year`) as int)") if "year" in df.columns else F.lit(None).cast("int")
    df = df.withColumn("year", F.coalesce(F.nullif(year, F.lit("")).cast("int"), own))
    numbers = [c for c in ("total_releases", "on-site_release_total", "off-site_release_total") if c in df.columns]
    return df.withColumns({c: number(c) for c in numbers} | ({"frs_id": number("frs_id", "bigint")} if "frs_id" in df.columns else {}))


def in_pounds(amount: Column, unit: Column) -> Column:
    """Amounts of a release in pounds: grams where the unit says so are converted, here and not in the scan."""
    return F.when(F.lower(F.trim(unit)) == "grams", amount / GRAMS_A_POUND).otherwise(amount)


#: The numbers of a report, in the source's order.
INJURIES = ["annual_average_employees", "total_hours_worked", "total_deaths", "total_dafw_cases", "total_djtr_cases", "total_other_cases", "total_injuries"]


@register("injuries")
def injuries(spark: SparkSession, path: str) -> DataFrame:
    """Yearly releases, archives or plain CSV files (the year of a release stands in its name, else that of the filing counts); rate of
    serious cases a 200,000 hours, where a missing count is none."""
    names = ["establishment_name", "company_name", "one", "state", "naics_code", "industry_description", "size", *INJURIES, "year_filing_for"]
    df = archive(spark, path, r"\.csv$", names)
    released = F.nullif(F.regexp_extract(F.regexp_extract("file", r"([^/]*)$", 1), r"(20\d\d)", 1), F.lit("")).cast("int")
    df = df.withColumns({c: number(c) for c in INJURIES}).withColumn("year", F.coalesce(released, F.expr("try_cast(trim(year_filing_for) as int)")))
    cases = F.coalesce("total_dafw_cases", F.lit(0.0)) + F.coalesce("total_djtr_cases", F.lit(0.0))
    return df.withColumn("dart_rate", safe_div(cases * 200_000, positive(F.col("total_hours_worked")))).drop("file")


@register("enforcement")
def enforcement(spark: SparkSession, path: str) -> DataFrame:
    # The columns that are kept, in the source's order.
    numbers = ["fac_total_penalties", "fac_penalty_count", "fac_inspection_count", "fac_qtrs_in_nc"]
    names = ["registry_id", "fac_name", "fac_state", "fac_naics_codes", *numbers, "fac_compliance_status", "fac_date_last_penalty", "caa_qtrs_in_nc", "cwa_qtrs_in_nc", "rcra_qtrs_in_nc", "fac_3yr_compliance_history"]
    df = archive(spark, path, r"\.csv$", names).drop("file")
    bad = F.regexp_count(F.substring("fac_3yr_compliance_history", 1, 12), F.lit("[VS]"))
    return df.withColumns({c: number(c) for c in numbers} | {"registry_id": number("registry_id", "bigint"), "bad_quarters": bad})


#: The columns of cases that are kept, in the source's order.
CASES = [
    "case_id", "trade_nm", "legal_name", "st_cd", "naic_cd", "case_violtn_cnt", "cmp_assd", "ee_violtd_cnt", "bw_atp_amt", "ee_atp_cnt", "findings_end_date", "flsa_repeat_violator",
    "flsa_cl_violtn_cnt", "flsa_cl_minor_cnt",
]


@register("wage_cases")
def wage_cases(spark: SparkSession, path: str) -> DataFrame:
    df = archive(spark, path, r"\.csv$", CASES).drop("file")
    year = F.year(F.to_date(F.expr("try_to_timestamp(findings_end_date)")))
    numbers = [c for c in CASES if c.endswith(("_cnt", "_amt", "_assd"))]
    return df.withColumns({c: number(c) for c in numbers}).where(year.between(2022, 2024))


@register("parent_links_binary")
def parent_links_binary(spark: SparkSession, path: str) -> DataFrame:
    """Owners of facilities from a binary workbook with a sheet a year (2010 to 2030; those that a file lacks are skipped)."""
    names = ["GHGRP FACILITY ID", "PARENT COMPANY NAME", "PARENT CO. PERCENT OWNERSHIP"]
    # Every sheet is a year: its rows are told by the sheet's name, so each file is unpacked once.
    raw = binary_sheets(spark, path, r"^20\d\d$", names, rename=lambda x: x.strip().upper())
    share = F.coalesce(F.expr("try_cast(trim(`PARENT CO. PERCENT OWNERSHIP`) as double)"), F.lit(100.0))
    return raw.select(
        F.expr("try_cast(trim(`GHGRP FACILITY ID`) as bigint)").alias("facility_id"), F.trim("PARENT COMPANY NAME").alias("parent_name_raw"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)).alias("parent_share_pct"), F.col("sheet").cast("int").alias("reporting_year"),
    ).where("facility_id is not null and parent_name_raw is not null")


def _positive(df: DataFrame) -> DataFrame:
    """Rows of a facility and a year with a positive amount."""
    df = df.withColumns({"facility_id": F.expr("try_cast(try_cast(trim(facility_id) as double) as bigint)"), "reporting_year": F.expr("try_cast(try_cast(trim(reporting_year) as double) as int)"), "co2_tonnes": number("co2_tonnes")})
    return df.where("facility_id is not null and reporting_year is not null and co2_tonnes > 0").drop("file")


@register("facility_fuel")
def facility_fuel(spark: SparkSession, path: str) -> DataFrame:
    """Sheet FUEL_DATA of a binary workbook, by position: headers change from release to release, places don't."""
    places = {"facility_id": 0, "reporting_year": 6, "fuel_general": 10, "fuel_specific": 11, "co2_tonnes": -1}
    return _positive(binary_workbook(spark, path, "FUEL_DATA", places, skip=6))


@register("facility_units")
def facility_units(spark: SparkSession, path: str) -> DataFrame:
    """Sheet UNIT_DATA of a binary workbook, by position, with is_cems: whether the amount was measured continuously."""
    places = {"facility_id": 0, "reporting_year": 6, "method": 11, "co2_tonnes": 13}
    df = _positive(binary_workbook(spark, path, "UNIT_DATA", places, skip=6))
    return df.withColumn("is_cems", F.coalesce(F.col("method").rlike("(?i)Tier4|CEMS|P75"), F.lit(False)))


@register("revenue")
def revenue(spark: SparkSession, path: str) -> DataFrame:
    """Frames of several concepts (JSON): the first concept in a stated order wins a company year."""
    frames = spark.read.schema("tag string, ccp string, data array<struct<cik:bigint,entityName:string,val:double,`end`:string>>").json(path)
    rows = frames.select("tag", F.regexp_extract("ccp", r"(\d{4})", 1).cast("int").alias("year"), F.inline("data"))
    rows = rows.withColumn("prio", F.array_position(F.array(*map(F.lit, REVENUE_CONCEPTS)), F.col("tag"))).where("prio > 0")
    best = keep_first(rows, ["cik", "year"], [F.col("prio"), F.desc("end"), F.desc("val")])
    return best.select("cik", F.col("entityName").alias("entity"), "year", (F.col("val") / 1e6).alias("revenue_musd"), F.col("tag").alias("concept"))


@register("targets")
def targets(spark: SparkSession, path: str) -> DataFrame:
    """A workbook of climate targets: years out of texts, flags by what the status says."""
    # The columns that are kept, in the source's order.
    names = ["company_name", "isin", "lei", "sector", "location", "near_term_status", "near_term_target_classification", "near_term_target_year", "long_term_status", "net_zero_status", "net_zero_year"]
    df = workbook(spark, path, "", names, rename=lambda x: x.strip().lower().replace(" ", "_").replace("-", "_")).drop("file")
    year = lambda c: F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit("")).cast("int").alias(c)
    says = lambda c, word: F.coalesce(F.lower(c).contains(word), F.lit(False))
    removed = says("near_term_status", "removed") | says("net_zero_status", "removed")
    return df.withColumns(
        {"near_term_year": year("near_term_target_year"), "net_zero_year": year("net_zero_year"), "commitment_removed": removed, "has_validated_target": says("near_term_status", "targets set")}
    ).withColumnsRenamed({"near_term_target_classification": "near_term_class", "sector": "sbti_sector"}).drop("near_term_target_year")


#: The headers of the ratings file and the names of its columns here.
RATINGS = {
    "esgScore.tot": "esg_risk_total", "esgScore.env": "esg_risk_env", "esgScore.soc": "esg_risk_soc", "esgScore.gov": "esg_risk_gov",
    "esgRank.tot": "esg_percentile", "esgRating": "esg_rating_label", "asOf": "as_of", "Market.Cap": "market_cap_usd",
}


@register("ratings")
def ratings(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path).withColumnsRenamed(RATINGS)
    df = _optional(df, ["ticker", "company", "sector", *RATINGS.values()])
    numbers = {c: number(c) for c in ("esg_risk_total", "esg_risk_env", "esg_risk_soc", "esg_risk_gov", "esg_percentile", "market_cap_usd")}
    return df.withColumn("ticker", _ticker("ticker")).withColumns(numbers).where("esg_risk_total is not null")


@register("hard_variables")
def hard_variables(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    return df.select(*[F.trim(f"`{c}`").alias(c) for c in df.columns]).withColumn("ticker", _ticker("ticker"))


@register("benchmark_scores")
def benchmark_scores(spark: SparkSession, path: str) -> DataFrame:
    """A nested document: one row a ticker of every company that was assessed."""
    score = "struct<tpq:double,ctt:double,act_grade:string,social:double,nature:double,just_transition:double,source:struct<url:string,retrieved_at:string>>"
    company = f"struct<wba:struct<name:string>,match_method:string,tickers:array<string>,assessment:{score}>"
    raw = spark.read.schema(f"companies array<{company}>").option("multiLine", True).json(path)
    rows = raw.select(F.inline("companies")).where("assessment is not null")
    grades = [f"assessment.{c}" for c in ("tpq", "ctt", "act_grade", "social", "nature", "just_transition")]
    return rows.select(
        F.explode("tickers").alias("ticker"), F.col("wba.name").alias("wba_name"), "match_method", *grades,
        F.col("assessment.source.url").alias("profile_url"), F.col("assessment.source.retrieved_at").alias("retrieved_at"),
    ).withColumn("ticker", F.replace("ticker", F.lit("."), F.lit("-")))


@register("yearly_emissions")
def yearly_emissions(spark: SparkSession, path: str) -> DataFrame:
    """A sheet with a column a year, three rows above the header: one row a facility and year, positive only."""
    years = [str(y) for y in range(2011, 2024)]
    df = workbook(spark, path, "Direct", ["Facility Id", "FRS Id", "Facility Name", *years], skip=3, rename=lambda x: x.strip().removesuffix(" Total reported direct emissions"))
    long = df.unpivot(["Facility Id", "Facility Name"], years, "year", "value")
    typed = long.select(number("Facility Id", "bigint").alias("facility_id"), F.col("Facility Name").alias("facility_name"), number("year", "int"), number("value").alias("direct_t"))
    return typed.where("direct_t > 0")


@register("parent_links")
def parent_links(spark: SparkSession, path: str) -> DataFrame:
    """Owners of facilities with their share in percent, 100 where none is given, clipped to 0..100."""
    raw = _csv(spark, path)
    df = raw.toDF(*[c.strip().upper() for c in raw.columns])
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.expr("try_cast(`PARENT CO. PERCENT OWNERSHIP` as double)"), F.lit(100.0))))
    return df.select(
        F.expr("try_cast(`GHGRP FACILITY ID` as bigint)").alias("facility_id"), F.trim("PARENT COMPANY NAME").alias("parent_name_raw"), share.alias("parent_share_pct"),
        F.expr("try_cast(`REPORTING YEAR` as int)").alias("reporting_year"),
    )


@register("latest_revenue")
def latest_revenue(spark: SparkSession, path: str) -> DataFrame:
    df = _lower(_csv(spark, path)).select(_ticker("ticker").alias("ticker"), number("revenue_ttm_busd"))
    return df.select("ticker", (F.col("revenue_ttm_busd") * 1e9).alias("revenue_usd"), F.lit(0.12).alias("revenue_se_rel"))


@register("embedded_data")
def embedded_data(spark: SparkSession, path: str) -> DataFrame:
    """The JSON that a page embeds in <script id="data">, one document a file."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    cut = F.nullif(F.regexp_extract("value", r'(?s)<script[^>]*id="data"[^>]*>(.*?)</script>', 1), F.lit(""))
    return pages.select("file", F.try_parse_json(cut).alias("data")).where("data is not null")
