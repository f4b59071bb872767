"""Quality rules: line-first cleaning (native).

Every line is judged on its own by punctuation, navigation and boilerplate
rules; failing lines are removed; a document that loses too much text, or that
fails one of the document-wide base rules, is rejected.  The plan is one
projection: no shuffle, no Python, memory bounded by the largest text.

Repeated words are found without exploding: 64-bit hashes of all 3-word
windows are sorted inside the row next to their positions, neighbours with
equal hashes are windows that occur twice or more, and the covered words are
counted from the gaps between the sorted positions.  (Two different windows
of one text share a hash with a chance of about n^2 / 2^65.)

Edge cases: a null text counts as empty; an empty text has no words, fails the
base rules and is rejected; blank lines pass and weigh nothing; repeated rows
are judged each on its own; other columns pass through untouched, and names
that clash with the added ones are replaced by them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HAS_WORD, SPACE, words


@dataclass(frozen=True)
class LineRules:
    """Fixed values of the rules that judge lines and what they may remove."""

    #: A line of this many words or more must hold a sentence end somewhere.
    punctuated_from_words: int = 12
    sentence_end: str = r"[.!?…。！？]"
    #: Menus: this many separators in a line.
    navigation: str = r"[|»>•·].*?[|»>•·].*?[|»>•·]"
    #: Rows of links and buttons.
    buttons: str = (
        r"(?i)^\W*(?:home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|read more|"
        r"share|tweet|skip to content|print|contact us|about us|site map|sitemap)\W*$"
    )
    boilerplate: str = (
        r"(?i)(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|uses cookies|"
        r"subscribe to our|javascript (?:is disabled|must be enabled)|lorem ipsum|released under the \w+ licen[cs]e|"
        r"licensed under the|copyright (?:\(c\)|©))"
    )
    #: Shouting and symbol noise: words that end in runs of marks, three in a line.
    noise: str = r"[!?#*$%&<>~^=]{2}\s.*?[!?#*$%&<>~^=]{2}\s.*?[!?#*$%&<>~^=]{2}(?:\s|$)"
    #: Document-wide: least words, and the share of words in repeated windows (percent).
    least_words: int = 50
    most_repeated_percent: int = 50
    #: Share of the characters that the line rules may remove (percent).
    most_removed_percent: int = 50


def _line_passes(line: Column, rules: LineRules) -> Column:
    unpunctuated = (F.size(F.split(line, SPACE)) >= rules.punctuated_from_words) & ~line.rlike(rules.sentence_end)
    return ~(
        line.rlike(rules.navigation)
        | line.rlike(rules.noise)
        | line.rlike(rules.boilerplate)
        | line.rlike(rules.buttons)
        | unpunctuated
    )


def _ordered_if_repeated(hashes: Column) -> Column:
    """The windows as struct<h, i>, sorted; null where no window repeats."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(pairs))


def measure(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, cleaned (the text without failing lines) and kept."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "kept"]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(
        *rest, text.alias("_text"), words(F.col("text")).alias("_words"), F.split(text, "\n").alias("_lines")
    )
    w = F.col("_words")
    df = df.select(
        *rest,
        "_text",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter("_lines", lambda x: x.rlike(HAS_WORD)).alias("_spoken"),
        F.array_join(F.filter("_lines", lambda x: _line_passes(x, rules)), "\n").alias("cleaned"),
        F.when(
            F.size(w) > 3,
            F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.size(w) - 2),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_hashes"),
    )
    kept_columns = [*rest, "_text", "n_words", "word_chars", "n_symbols", "cleaned"]
    df = df.select(
        *kept_columns,
        (F.size("_spoken") - F.size(F.array_distinct("_spoken"))).cast("long").alias("n_dup_lines"),
        _ordered_if_repeated(F.col("_hashes")).alias("_ordered"),
    )
    o = F.col("_ordered")
    twice = F.filter(o, lambda x, i: (F.get(o, i - 1)["h"] == x["h"]) | (F.get(o, i + 1)["h"] == x["h"]))
    df = df.select(*kept_columns, "n_dup_lines", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_at"))
    at = F.col("_at")
    gaps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    df = df.select(*kept_columns, "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < rules.least_words) | (
        100 * F.col("n_repeat_words") > rules.most_repeated_percent * F.col("n_words")
    )
    lost = 100 * (F.length("_text") - F.length("cleaned")) > rules.most_removed_percent * F.length("_text")
    # A filter on these would be pushed down with all that they are made of, and that evaluated
    # for every word again; no filter passes a row number, so the rules stay one projection.
    here = F.monotonically_increasing_id() >= 0
    return df.withColumns({"base_failed": failed & here, "kept": ~failed & ~lost & here}).drop("_text")


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that are kept, with their cleaned texts, in the columns of docs."""
    found = measure(docs, rules).where("kept")
    back = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return found.select(*[back[c].alias(c) if c in back else F.col(f"`{c}`") for c in docs.columns])
