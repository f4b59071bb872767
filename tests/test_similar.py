"""The index of the similarity join: no pair with the cutoff is lost, few others are met."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import identity, similar


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = left + 1 if x == y else max(row[j], row[j - 1])
            left = keep
    return row[-1]


def test_bit_vectors_count_the_common_subsequence():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert similar.common(similar.places(a), len(a), b) == brute_common(a, b)


@pytest.fixture(scope="module")
def forms():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    out = {" ".join(sorted(rng.sample(words, rng.randint(1, 4)))) for _ in range(900)}
    for form in list(out)[:500]:  # near ones
        letters = list(form)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(letters))
            letters[at : at + rng.randint(0, 1)] = rng.choice("abcxyz")
        out.add("".join(letters))
    return sorted(out)


@pytest.mark.parametrize("cutoff", [96.0, 92.0, 85.0])
def test_every_pair_with_the_cutoff_is_met(spark, forms, cutoff):
    left = spark.createDataFrame([(x,) for x in forms[::3]], "form string").withColumn("n", F.length("form"))
    right = spark.createDataFrame([(x, x) for x in forms], "other string, choice string").withColumn("k", F.length("other"))
    indexed = {(r["form"], r["other"]) for r in similar.indexed_pairs(left, right, cutoff).collect()}
    blocked = {(r["form"], r["other"]) for r in similar.blocked_pairs(left, right, cutoff).collect()}
    want = {(a, b) for a in forms[::3] for b in forms if 200.0 * brute_common(a, b) >= cutoff * (len(a) + len(b))}
    assert want <= indexed | blocked and not indexed & blocked
    band = sum(abs(len(a) - len(b)) <= (1 - cutoff / 100) * (len(a) + len(b)) for a in forms[::3] for b in forms)
    assert len(indexed | blocked) <= 0.05 * band or cutoff < 90


@pytest.mark.parametrize("cutoff", [92.0, 75.0])
def test_best_matches_of_many_names(spark, forms, cutoff):
    names, choices = forms[::4], [x for k, x in enumerate(forms) if k % 4]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    want = {}
    for n in names:
        best = min((-similar.token_sort_ratio(n, c), c) for c in choices)
        if -best[0] >= cutoff:
            want[n] = (best[1], -best[0])
    got = {r["name"]: (r["match"], r["score"]) for r in similar.best_matches(frame(names), frame(choices), cutoff).collect()}
    assert got == want


def test_ownership_combines_owners_of_a_ticker(spark):
    facilities = spark.createDataFrame(
        [("f", 2020, "Alpha Inc (30%); Alpha Energy (20%); Beta Works (50%)"), ("f", 2024, "Beta; Alphaa Steel Works"), ("g", 2020, None), ("h", None, "Beta")],
        "facility string, year int, owner string",
    )
    lookup = spark.createDataFrame([("alpha", "A"), ("alpha steel works", "S")], "key string, ticker string")
    overrides = spark.createDataFrame([(0, "beta", "B")], "ordinal int, key string, ticker string")
    rules = spark.createDataFrame([("beta works", "B", 2021, None), ("beta", "B", None, 2023)], "key string, ticker string, since int, until int")
    got = {tuple(r[c] for c in ("facility", "year", "ticker", "method")): (round(r["share"], 6), round(r["confidence"], 6)) for r in identity.ownership(facilities, lookup, overrides, rules).collect()}
    assert got == {
        ("f", 2020, "A", "exact"): (0.5, 0.85), ("f", 2024, "S", "fuzzy"): (0.5, round(34 / 35, 6)), ("h", None, "B", "override"): (1.0, 0.95),
    }
