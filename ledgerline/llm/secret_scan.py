r"""Secret scans: a trigram inverted index in front of regular expressions (native).

1. From each rule's expression a Boolean query over trigrams is derived: literal
   runs of three characters or more give an AND of trigrams, alternatives give an
   OR, classes, optional parts and short literals give nothing.
2. index() builds posting lists: for every trigram that some query needs, the
   sorted keys (hashes) of the different texts that hold it.  Lists are cut into
   blocks of about BLOCK texts, so that no list is one task's load and a list's size
   doesn't grow with the corpus; copies of a text are one entry.
3. candidates() intersects and unites the lists of a block as the queries say.
4. Texts that a rule's query leaves are verified by its expression; a rule whose query
   is empty (it has no mandatory trigram) scans every text.  Up to SMALL candidate
   keys are broadcast (16 bytes each), more are joined by a shuffle.  Texts whose hashes
   are equal share an entry, which costs a verification and can lose nothing.

Matches and their places come from two native calls: the matches, and the text
split by them; places are running sums of both lengths in code points.

Edge cases: null and empty texts have no spans; repeated rows are scanned each
on its own; other columns pass through, whatever their names, and a column that is
named spans is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, sums_before


@dataclass(frozen=True)
class Rule:
    """kind; pattern in the syntax that Java and Python share; group and least:
    the match counts if that group has so many characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds, in the order in which they are listed.  (Runs of
#: [0-9a-f] and of AKIA[A-Z0-9] are maximal, so a least length can be part of the
#: expression there; a short assignment, though, uses up its text.)
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Public shapes of credentials that the method adds.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

Query = tuple  # ("all", *queries), ("any", *queries) or ("tri", trigram); ("all",) says nothing


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-case trigrams that every match satisfies."""

    def all_of(parts: list[Query]) -> Query:
        flat = [x for p in parts for x in (p[1:] if p[0] == "all" else [p])]
        return ("all", *dict.fromkeys(flat))

    def literal(run: str) -> list[Query]:
        return [("tri", run[i : i + 3]) for i in range(len(run) - 2)]

    def of(tree) -> Query:
        parts, run = [], ""
        for op, arg in tree:
            if op is sre.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            parts += literal(run)
            run = ""
            if op is sre.SUBPATTERN:
                parts.append(of(arg[-1]))
            elif op is sre.BRANCH:
                branches = [of(x) for x in arg[1]]
                if all(len(b) > 1 for b in branches):
                    parts.append(("any", *branches))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                parts.append(of(arg[2]))
        return all_of(parts + literal(run))

    return of(sre_parse.parse(pattern))


def _trigrams(query: Query) -> list[str]:
    return [query[1]] if query[0] == "tri" else [t for q in query[1:] for t in _trigrams(q)]


SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


def _steps(k: int) -> Column:
    """How far every match of rule k takes its reader: the gap before it and its own length."""
    gaps = F.slice(F.col(f"_g{k}"), F.lit(1), F.size(f"_m{k}"))
    return F.when(F.size(f"_m{k}") > 0, F.zip_with(gaps, F.col(f"_m{k}"), lambda gap, m: (gap + F.length(m)).cast("long")))


def _spans(k: int, rule: Rule) -> Column:
    """The spans of rule k from its matches _mk, their steps _sk, the sums before these _bk and the lengths of its group _vk."""
    matches = F.col(f"_m{k}")
    ends = F.zip_with(F.col(f"_b{k}"), F.col(f"_s{k}"), lambda before, step: (before + step).cast("int"))

    def span(m, end):
        return F.struct((end - F.length(m)).alias("start"), F.lit(k).alias("kind_no"), end.alias("end"), F.lit(rule.kind).alias("kind"))

    found = F.zip_with(matches, ends, span)
    if rule.least:
        long_enough = F.zip_with(found, F.col(f"_v{k}"), lambda s, v: F.when(v >= rule.least, s))
        found = F.filter(long_enough, lambda s: s.isNotNull())
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(SPANS))


#: Texts of a block of posting lists, about; keys of candidates that are broadcast.
BLOCK, SMALL = 1_000, 500_000


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def index(docs: DataFrame, trigrams: list[str], block: int = BLOCK) -> DataFrame:
    """The inverted index: block, trigram (its number in the list) and texts (sorted keys) of all posting lists."""
    blocks = max(1, -(-docs.count() // block))
    low = docs.select(_key(F.col("text")).alias("key"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), j) for j, t in enumerate(trigrams)]))
    found = low.select("key", F.explode(held).alias("trigram"))
    return found.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram").agg(F.sort_array(F.collect_set("key")).alias("texts"))


def candidates(postings: DataFrame, trigrams: list[str], queries: dict[int, Query]) -> DataFrame:
    """key and mask (bit r: the text satisfies the query of rule r) of the texts that satisfy any query."""
    lists = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "texts"))).alias("lists"))
    number = {t: j for j, t in enumerate(trigrams)}
    none = F.array().cast("array<bigint>")

    def texts(q: Query) -> Column:
        if q[0] == "tri":
            return F.coalesce(F.try_element_at("lists", F.lit(number[q[1]])), none)
        return reduce(F.array_intersect if q[0] == "all" else F.array_union, [texts(x) for x in q[1:]])

    def marked(r: int, q: Query) -> Column:
        return F.transform(texts(q), lambda key: F.struct(key.alias("key"), F.lit(1 << r).cast("long").alias("bit")))

    found = [marked(r, q) for r, q in queries.items()]
    each = lists.select(F.explode(F.concat(*found)).alias("c"))
    return each.groupBy(F.col("c.key").alias("key")).agg(F.bit_or("c.bit").alias("mask"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """docs with spans array<struct<start, kind_no, end, kind>>, sorted; end is exclusive."""
    query = [trigram_query(r.pattern) for r in rules]
    selective = {r: q for r, q in enumerate(query) if len(q) > 1}
    trigrams = list(dict.fromkeys(t for q in query for t in _trigrams(q)))
    rest = [c for c in docs.columns if c != "spans"]
    # All columns of docs go in one, lest their names clash with those in between.
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(F.col("text")).alias("key"))
    if selective:
        found = stored(candidates(index(docs, trigrams, block), trigrams, selective), "secret-candidates")
        df = df.join(F.broadcast(found) if found.count() <= small else found, "key", "left")
    else:
        df = df.withColumn("mask", F.lit(0).cast("long"))
    t = F.coalesce(F.col("row.text"), F.lit(""))
    empty = F.array().cast("array<string>")

    def matches(r: int, rule: Rule) -> Column:
        every = F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(0))
        return F.when(F.getbit(F.coalesce("mask", F.lit(0).cast("long")), F.lit(r)) == 1, every).otherwise(empty) if r in selective else every

    df = df.select("row", *[matches(r, rule).alias(f"_m{r}") for r, rule in enumerate(rules)])
    # The few rows with matches are taken apart; for all others these are constants.
    df = df.select(
        "row",
        *[f"_m{k}" for k in range(len(rules))],
        *[F.when(F.size(f"_m{k}") > 0, F.transform(F.split(t, r.pattern), lambda x: F.length(x))).alias(f"_g{k}") for k, r in enumerate(rules)],
        *[
            F.when(F.size(f"_m{k}") > 0, F.transform(F.regexp_extract_all(t, F.lit(r.pattern), F.lit(r.group)), lambda x: F.length(x))).alias(f"_v{k}")
            for k, r in enumerate(rules)
            if r.least
        ],
    )
    numbers = range(len(rules))
    kept = ["row", *[f"_m{k}" for k in numbers], *[f"_v{k}" for k in numbers if rules[k].least]]
    df = df.select(*kept, *[_steps(k).alias(f"_s{k}") for k in numbers])
    df = df.select(*kept, *[f"_s{k}" for k in numbers], *[F.when(F.size(f"_m{k}") > 0, sums_before(F.col(f"_s{k}"))).alias(f"_b{k}") for k in numbers])
    df = df.select("row", F.sort_array(F.concat(*[_spans(k, r) for k, r in enumerate(rules)])).alias("_spans"))
    return df.select(*[F.col("row").getField(c).alias(c) for c in rest], F.col("_spans").alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, mask: str = "*") -> DataFrame:
    """docs whose texts have every character of a span replaced, in the columns of docs."""
    found = scan(docs, rules)

    def cut(acc, s):
        begin = F.greatest(acc["at"], s["start"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(
                acc["out"],
                F.substring(F.col("text"), acc["at"] + 1, begin - acc["at"]),
                F.repeat(F.lit(mask), F.greatest(F.lit(0), s["end"] - begin)),
            ).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate("spans", start, cut, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
