"""The most similar of many names: similarity of sorted tokens, found through an index.

The similarity of two forms (sorted tokens) is 200 * common / (n + k), common being the longest common subsequence and
n, k the lengths.  A cutoff c asks for common >= c * (n + k) / 200, so at most e = n + k - 2 * common letters are dropped
or put in between the two.  If one form is cut into e + 1 segments, some segment i lies unchanged in the other, with at
most i changes before it and e - i after it; so it starts within i places of where it stood from the left, and within
e - i places counted from the right.  Forms therefore meet by (lengths, segment, piece of text), and no pair with the
cutoff is lost.

Only the best choice is asked for, so cutoffs are tried from the top: equal forms, then LEVELS, then the cutoff itself,
and a name with a match at one level doesn't go to the next, where segments are shorter.  Where segments would be
of one letter (a low cutoff), lengths alone make the pairs, in salted blocks.  Pairs are dropped by counts of
letters, and the rest is scored by bit vectors, one step a letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.shared import stored

LEVELS = (95.0, 90.0, 85.0, 80.0)
#: Choices of one length are dealt to so many tasks where lengths alone make pairs.
SALTS = 16
#: Shorter segments select too little to be looked up.
SHORTEST = 2


def sorted_tokens(name: Column) -> Column:
    """Tokens in order, joined by single blanks: blank as Python's split() has it."""
    tokens = F.split(name, r"(?U)[\s\x1c-\x1f]+")
    return F.array_join(F.array_sort(F.filter(tokens, lambda x: x != "")), " ")


def places(form: str) -> dict[str, int]:
    """For every letter of a form a bit for each place where it stands."""
    out: dict[str, int] = {}
    for k, c in enumerate(form):
        out[c] = out.get(c, 0) | 1 << k
    return out


def common(where: dict[str, int], n: int, other: str) -> int:
    """The length of the longest common subsequence with a form of n letters: zeros of v mark where a row of the
    table rises, and a sum with carries moves all of them at once."""
    whole = (1 << n) - 1
    v = whole
    for c in other:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & whole
    return n - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common(places(a), len(a), b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    """100 * 2 * common / (length a + length b) of the names with sorted tokens."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _letters(forms: np.ndarray, kinds: int = 64) -> np.ndarray:
    """How often every form has each class of letters; forms share at most the smaller of both counts."""
    out = np.zeros((len(forms), kinds), np.int16)
    for row, form in zip(out, forms, strict=True):
        if form:
            codes, counts = np.unique(np.frombuffer(form.encode("utf-32-le"), np.uint32) % kinds, return_counts=True)
            row[codes] = counts
    return out


def _scores(cutoff: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            (a, forms), (b, others) = pd.factorize(batch["form"]), pd.factorize(batch["other"])
            forms, others = np.asarray(forms, object), np.asarray(others, object)
            size = np.array([len(f) for f in forms])[a] + np.array([len(f) for f in others])[b] if len(batch) else np.zeros(0)
            shared = np.minimum(_letters(forms)[a], _letters(others)[b]).sum(1)
            near = np.flatnonzero((200.0 * shared >= cutoff * size) | (size == 0))
            near = near[np.argsort(a[near], kind="stable")]
            scores, now, where = np.zeros(len(near)), -1, {}
            for k, row in enumerate(near.tolist()):
                if a[row] != now:
                    now = a[row]
                    where = places(forms[now])
                n = int(size[row])
                scores[k] = 200.0 * common(where, len(forms[now]), others[b[row]]) / n if n else 100.0
            out = batch.iloc[near][["form", "choice"]].assign(score=scores)
            yield out[out["score"] >= cutoff]

    return run


def _met(df: DataFrame, cutoff: float) -> DataFrame:
    """df (n, k) where the cutoff can be met, with edits and whether segments are long enough to be looked up."""
    need = F.ceil(cutoff * (F.col("n") + F.col("k")) / 200.0 - 1e-9).cast("int")
    df = df.where(need <= F.least("n", "k")).withColumn("edits", F.col("n") + F.col("k") - 2 * need)
    return df.withColumn("indexed", F.floor(F.col("k") / (F.col("edits") + 1)) >= SHORTEST)


def _lengths(size: str, cutoff: float) -> Column:
    """All lengths that a match of a form of this size can have."""
    least = cutoff / (200.0 - cutoff)
    return F.sequence(F.greatest(F.lit(0), F.floor(F.col(size) * least) - 1).cast("int"), (F.ceil(F.col(size) / least) + 1).cast("int"))


def _segments(df: DataFrame) -> DataFrame:
    """df (n, k, edits) by the segments of the form of length k: i, first, length."""
    parts = F.col("edits") + 1
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    base, longer = F.floor(F.col("k") / parts).cast("int"), F.greatest(F.lit(0), F.col("i") - (parts - F.col("k") % parts))
    return df.withColumn("first", (F.col("i") * base + longer).cast("int")).withColumn("length", base + (F.col("i") >= parts - F.col("k") % parts).cast("int"))


def indexed_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """form, other, choice: pairs that share a segment where a pair of the cutoff must; left: form, n; right: other, choice, k."""
    probes = _segments(_met(left.withColumn("k", F.explode(_lengths("n", cutoff))), cutoff).where("indexed"))
    moved = F.col("n") - F.col("k")
    low = F.greatest(F.lit(0), F.col("first") - F.col("i"), F.col("first") + moved - (F.col("edits") - F.col("i")))
    high = F.least(F.col("n") - F.col("length"), F.col("first") + F.col("i"), F.col("first") + moved + (F.col("edits") - F.col("i")))
    probes = probes.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    probes = probes.select("form", "n", "k", "i", F.expr("substring(form, at + 1, length)").alias("piece"))
    kept = _segments(_met(right.withColumn("n", F.explode(_lengths("k", cutoff))), cutoff).where("indexed"))
    kept = kept.select("other", "choice", "n", "k", "i", F.expr("substring(other, first + 1, length)").alias("piece"))
    return probes.join(kept, ["n", "k", "i", "piece"]).select("form", "other", "choice").distinct()


def blocked_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """form, other, choice: all pairs of lengths that may have the cutoff and are too short, or too loose, for segments."""
    if cutoff > 0:
        left = _met(left.withColumn("k", F.explode(_lengths("n", cutoff))), cutoff).where("not indexed").select("form", "n", "k")
    else:
        left, right = left.withColumn("k", F.lit(0)), right.withColumn("k", F.lit(0))
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = right.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(SALTS)).cast("int"))
    return left.join(right, ["k", "salt"]).select("form", "other", "choice")


def _best(pairs: DataFrame, cutoff: float) -> DataFrame:
    scored = pairs.mapInPandas(_scores(cutoff), "form string, choice string, score double")
    return scored.groupBy("form").agg(F.min_by("choice", F.struct(-F.col("score"), F.col("choice"))).alias("match"), F.max("score").alias("score"))


def best_matches(names: DataFrame, choices: DataFrame, cutoff: float) -> DataFrame:
    """name, match, score: the most similar choice with at least the cutoff, the first of equals.

    Names and choices meet as sorted tokens, each distinct form once; names and forms that are null match nothing."""
    named = stored(names.select("name", sorted_tokens(F.col("name")).alias("form")).where("form is not null").distinct(), "similar-names")
    left = named.select("form", F.length("form").alias("n")).distinct()
    right = choices.select("name", sorted_tokens(F.col("name")).alias("other")).where("other is not null").groupBy("other").agg(F.min("name").alias("choice"))
    right = stored(right.withColumn("k", F.length("other")), "similar-choices")
    equal = left.join(right, F.col("form") == F.col("other")).select("form", F.col("choice").alias("match"), F.lit(100.0).alias("score"))
    done = [stored(equal.where(F.lit(cutoff <= 100)), "similar-equal")]
    left = stored(left.join(done[0], "form", "left_anti"), "similar-open")
    for level in [*[x for x in LEVELS if x > cutoff], cutoff]:
        if cutoff > 100 or not left.limit(1).count():
            break
        pairs = blocked_pairs(left, right, level)
        if level > 0:
            pairs = pairs.unionByName(indexed_pairs(left, right, level))
        done.append(stored(_best(pairs, level), "similar-level"))
        left = stored(left.join(done[-1], "form", "left_anti"), "similar-open")
    best = done[0]
    for x in done[1:]:
        best = best.unionByName(x)
    return named.join(best, "form").select("name", "match", "score")
