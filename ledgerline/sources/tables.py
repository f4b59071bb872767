"""Readers: tables of a data folder, and typed scans of raw files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_registry: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    """Registers a source: f(spark, path) -> DataFrame with its declared columns."""

    def keep(f):
        _registry[name] = f
        return f

    return keep


def available() -> list[str]:
    return sorted(_registry)


def get(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return _registry[name]


def fetch(spark: SparkSession, name: str, path: str, cache: str | None = None, force: bool = False) -> DataFrame:
    """Reads a source, through a Parquet copy where one is asked for."""
    if cache is None:
        return get(name)(spark, path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(cache)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    if force or not there:
        get(name)(spark, path).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def text_columns(spark: SparkSession, path: str, names: list[str], header: bool = True, separator: str = ",") -> DataFrame:
    """A CSV file with every column as text: typing is the scan's job, not the file's."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).csv(path, header=header, sep=separator, mode="PERMISSIVE")


def header_name(raw: str) -> str:
    """"12. FOO BAR/BAZ " -> "foo_bar_baz"."""
    return raw.split(". ", 1)[-1].strip().lower().replace(" ", "_").replace("/", "_")


@register("issuers")
def issuers(spark: SparkSession, path: str) -> DataFrame:
    """Symbol, Security, GICS Sector, GICS Sub-Industry, CIK -> the issuer master."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        F.replace(F.trim("Symbol"), F.lit("."), F.lit("-")).alias("ticker"), F.trim("Security").alias("company"),
        F.trim("GICS Sector").alias("gics_sector"), F.trim("GICS Sub-Industry").alias("gics_sub_industry"),
        F.expr("try_cast(CIK as bigint)").alias("cik"),
    ).where("cik is not null")


@register("company_facts")
def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """Nested filing facts (one JSON document a company) -> namespace, tag, unit and one row a fact."""
    fact = "array<struct<`start`:string,`end`:string,val:double,filed:string,form:string,accn:string>>"
    schema = f"cik bigint, facts map<string, map<string, struct<units: map<string, {fact}>>>>"
    raw = spark.read.schema(schema).json(path)
    spaces = raw.select("cik", F.explode("facts").alias("namespace", "tags"))
    tags = spaces.select("cik", "namespace", F.explode("tags").alias("tag", "body"))
    units = tags.select("cik", "namespace", "tag", F.explode("body.units").alias("unit", "facts"))
    facts = units.select("cik", "namespace", "tag", "unit", F.posexplode("facts").alias("ordinal", "fact"))
    return facts.select("cik", "namespace", "tag", "unit", "ordinal", "fact.*")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, form: str = "parquet") -> None:
    writer = df.write.mode("overwrite").format(form)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
