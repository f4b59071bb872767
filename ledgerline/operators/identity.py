"""Names: normal forms, owner lists, prefix matches, similarity of sorted tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.similar import best_matches
from ledgerline.sources.shared import stored

#: Legal forms and generic words of company names.
SUFFIXES = [
    "incorporated", "inc", "corporation", "corp", "company", "companies", "co", "limited", "ltd", "llc", "lllp", "llp", "lp", "plc", "holdings", "holding",
    "group", "the", "and", "na", "usa", "us", "america", "american", "international", "intl", "worldwide", "global", "enterprises", "industries",
    "partners", "partnership", "trust", "reit", "class",
]
#: Legal forms of the second normal form, which drops whole tokens.
LEGAL = [
    "incorporated", "inc", "corporation", "corp", "company", "co", "llc", "l l c", "lp", "llp", "plc", "ltd", "limited", "holdings", "holding", "group",
    "the", "usa", "us", "america", "american", "international", "intl", "enterprises", "industries", "partners", "sa", "nv", "ag", "gmbh", "trust",
]
#: The generic words that may follow a company's name.
GENERIC_TAIL = [
    "energy", "resources", "power", "holdings", "financial", "technologies", "systems", "brands", "services", "communications", "entertainment",
    "materials", "chemical", "chemicals", "pharmaceuticals", "petroleum",
]


def _blanks(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_name(name: Column) -> Column:
    """Lower case, without parentheses and what they hold, letters and digits only, no legal forms, single blanks."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), r"\([^)]*\)", " "), r"[^a-z0-9\s]", " ")
    return _blanks(F.regexp_replace(plain, rf"\b({'|'.join(SUFFIXES)})\b", " "))


def normalize_tokens(name: Column) -> Column:
    """The second form: tokens that are legal forms go, but a name of nothing else stays as it is."""
    tokens = F.filter(F.split(_blanks(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " ")), " "), lambda x: x != "")
    kept = F.filter(tokens, lambda x: ~x.isin(*LEGAL))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(tokens), " ")


def split_owner_operator(raw: Column) -> Column:
    """"Alpha (Owner)|Beta (Operator)|Gamma" -> [(Alpha, owner), (Beta, operator), (Gamma, unknown)]."""
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    shape = r"(?s)^(.*)\(([^(]*)\)$"

    def of(p: Column) -> Column:
        fits = p.rlike(shape)
        role = F.lower(F.trim(F.regexp_replace(F.regexp_extract(p, shape, 2), r"\)+$", "")))
        return F.struct(F.when(fits, F.trim(F.regexp_extract(p, shape, 1))).otherwise(p).alias("name"), F.when(fits, role).otherwise("unknown").alias("role"))

    return F.transform(parts, of)


#: Fixed value: how a reduction target is worded.
TARGET = r"(?i)reduce\s+(?:absolute\s+)?(?:scope\s*1\s*and\s*(?:scope\s*)?2\s+)?(?:GHG\s+)?emissions\s+([\d.]+)\s*%\s+by\s+(\d{4})\s+from\s+a\s+(\d{4})\s+base\s*year"


def parse_target(text: Column) -> Column:
    """struct(rate, base_year, target_year): the log rate a year that a target's wording asks for; missing without one,
    for years in the wrong order and for shares outside 0 to 100."""
    part = lambda k, kind: F.nullif(F.regexp_extract(text, TARGET, k), F.lit("")).try_cast(kind)
    pct, target, base = part(1, "double"), part(2, "int"), part(3, "int")
    ok = (target > base) & (pct > 0) & (pct < 100)
    return F.struct(F.when(ok, F.log(1 - pct / 100) / (target - base)).alias("rate"), F.when(ok, base).alias("base_year"), F.when(ok, target).alias("target_year"))


def owner_valid(rules: DataFrame, owners: DataFrame) -> DataFrame:
    """owners (key, ticker, year, ...) inside the windows of rules (key, ticker, since, until): both ends open is never
    valid; pairs without a rule and missing years always are."""
    rule = rules.select(F.col("key").alias("_key"), F.col("ticker").alias("_ticker"), "since", "until", F.lit(True).alias("_ruled"))
    df = owners.join(rule, (F.col("key") == F.col("_key")) & (F.col("ticker") == F.col("_ticker")), "left")
    never = F.col("since").isNull() & F.col("until").isNull()
    inside = F.col("year").isNull() | ((F.col("since").isNull() | (F.col("year") >= F.col("since"))) & (F.col("until").isNull() | (F.col("year") <= F.col("until"))))
    return df.where(F.col("_ruled").isNull() | (~never & inside)).drop("_key", "_ticker", "since", "until", "_ruled")


def resolve(names: DataFrame, lookup: DataFrame, overrides: DataFrame, cutoff: float = 92.0) -> DataFrame:
    """name, key, ticker, method, confidence of every different name, by a cascade: the exact normal form, an override, an
    override followed by further words (the first in order), a company followed by one generic word, the most similar company.

    lookup: key (normal form), ticker; overrides: ordinal, key, ticker.  Prefixes end at word boundaries: all word prefixes of a
    name are equi-joined, so no pair is compared that doesn't share one."""
    keyed = stored(names.select("name").distinct().withColumn("key", normalize_name(F.col("name"))), "names")
    keys = keyed.where("key <> ''").select("key").distinct()
    tokens = F.split("key", " ")
    n = F.size(tokens)
    starts = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(tokens, F.lit(1), k), " "))).alias("start"))
    over = overrides.select(F.col("key").alias("start"), F.col("ticker").alias("t"), "ordinal")
    by_override = starts.join(over, "start").groupBy("key").agg(
        F.max(F.when(F.col("start") == F.col("key"), F.col("t"))).alias("override"), F.min_by("t", "ordinal").alias("prefix")
    )
    company = lookup.groupBy("key").agg(F.min("ticker").alias("ticker"))
    exact = company.select("key", F.col("ticker").alias("exact"))
    tail = F.element_at(tokens, -1)
    heads = keys.where((n > 1) & tail.isin(*GENERIC_TAIL)).select("key", F.array_join(F.slice(tokens, F.lit(1), n - 1), " ").alias("head"))
    by_head = heads.join(company.select(F.col("key").alias("head"), F.col("ticker").alias("parent")), "head").select("key", "parent")
    found = stored(keys.join(exact, "key", "left").join(by_override, "key", "left").join(by_head, "key", "left"), "name-steps")
    open_ = found.where("exact is null and override is null and prefix is null and parent is null")
    near = best_matches(open_.select(F.col("key").alias("name")), company.select(F.col("key").alias("name")), cutoff)
    near = near.join(company.withColumnRenamed("key", "match"), "match").select(F.col("name").alias("key"), F.col("ticker").alias("similar"), "score")
    found = found.join(near, "key", "left")
    steps = [("exact", "exact", F.lit(1.0)), ("override", "override", F.lit(0.95)), ("prefix", "override-prefix", F.lit(0.9)), ("parent", "parent-prefix", F.lit(0.85)), ("similar", "fuzzy", F.col("score") / 100)]
    method, confidence = F.lit("unmatched"), F.lit(0.0)
    for column, name, sure in reversed(steps):
        method, confidence = F.when(F.col(column).isNotNull(), name).otherwise(method), F.when(F.col(column).isNotNull(), sure).otherwise(confidence)
    verdicts = found.select(F.col("key").alias("_key"), F.coalesce(*[F.col(c) for c, *_ in steps]).alias("ticker"), method.alias("method"), confidence.alias("confidence"))
    return keyed.join(verdicts, F.col("key") == F.col("_key"), "left").select(
        "name", "key", "ticker", F.coalesce("method", F.lit("empty")).alias("method"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )


#: Fixed value: how an owner's share is written.
SHARE = r"\(([\d.]+)\s*%\)"


def parse_owners(raw: Column) -> Column:
    """"Alpha (US) (60%); Beta Corp." -> [(Alpha (US), 0.6), (Beta Corp, 0.4)]: only shares in parentheses are taken off a name,
    blanks, commas and full stops at its ends as well, and parts without a name go.  Named shares stay, the others get equal
    parts of the rest; shares above 1.01 in all are scaled to 1."""
    ends = lambda x: F.regexp_replace(F.regexp_replace(x, "^[ ,.]+", ""), "[ ,.]+$", "")
    share = lambda p: F.nullif(F.regexp_extract(p, SHARE, 1), F.lit("")).try_cast("double") / 100
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ";"), lambda p: F.struct(ends(F.regexp_replace(p, SHARE, "")).alias("name"), share(p).alias("share")))
    owners = F.filter(parts, lambda x: x["name"] != "")
    sum_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.coalesce(x["share"], F.lit(0.0)))
    open_ = F.size(F.filter(owners, lambda x: x["share"].isNull()))
    rest = F.when(open_ > 0, F.greatest(F.lit(0.0), 1.0 - sum_of(owners)) / open_)
    whole = F.transform(owners, lambda x: F.struct(x["name"], F.coalesce(x["share"], rest).alias("share")))
    total = sum_of(whole)
    return F.transform(whole, lambda x: F.struct(x["name"], F.when(total > 1.01, x["share"] / total).otherwise(x["share"]).alias("share")))


#: How an owner was found, the surest first.
METHODS = ["exact", "override", "override-prefix", "parent-prefix", "fuzzy"]


def ownership(facilities: DataFrame, lookup: DataFrame, overrides: DataFrame, rules: DataFrame, cutoff: float = 92.0) -> DataFrame:
    """facility, year, ticker, share, confidence, method from facilities (facility, year, owner: raw text): owners are parsed
    and resolved, pairs outside the windows of rules (see owner_valid) go, and those of one ticker are one row with
    the sum of shares (1 at most), the least confidence and the method of the first owner in the text."""
    rows = facilities.select("facility", "year", F.posexplode(parse_owners(F.col("owner"))).alias("place", "o")).select("facility", "year", "place", "o.*")
    rows = stored(rows, "owners")
    found = resolve(rows.select("name"), lookup, overrides, cutoff).where("ticker is not null")
    rows = rows.join(found, "name").select("facility", "year", "place", "key", "ticker", "share", "method", "confidence")
    valid = owner_valid(rules, rows)
    return valid.groupBy("facility", "year", "ticker").agg(
        F.least(F.sum("share"), F.lit(1.0)).alias("share"), F.min("confidence").alias("confidence"), F.min_by("method", "place").alias("method")
    )
