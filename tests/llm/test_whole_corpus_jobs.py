"""Corpus operators on rows that a cut would lose."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import common, near_dup, suffix_dedup

from .test_corpus_operators import removed


def licence_rows():
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = "This file is under the licence of 1999.\n"
    twice = line + letters(190)
    return [letters(rng.randint(0, 250)) + line + letters(rng.randint(0, 250)) for _ in range(60)] + [letters(90) + twice, twice + letters(40), line * 12]


def test_parts_cover_every_window_once_and_equal_windows_meet():
    window, texts = 200, [t.encode() for t in licence_rows()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    names, seen = {}, []
    for _, _, first, last, place in zip(*suffix_dedup.anchors(data, offsets, window), strict=True):
        for key, a, b in suffix_dedup.parts(data, int(first), int(last), int(place), window):
            for s in range(a, b + 1):
                names.setdefault(data[s : s + window].tobytes(), set()).add(key)
                seen.append(s)
    whole = [s for a, b in zip(offsets, offsets[1:]) for s in range(a, b - window + 1)]
    assert sorted(seen) == whole
    assert {len(keys) for keys in names.values()} == {1} and len(names) < len(whole)


@pytest.mark.parametrize("window", [200, 40])
def test_hot_anchors_are_split_without_loss(spark, monkeypatch, window):
    texts = licence_rows()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = [(i, *w) for i, w in enumerate(removed([t.encode() for t in texts], window))]
    largest = []
    for limit in (10**9, 1):
        monkeypatch.setattr(suffix_dedup, "HOT", limit)
        assert sorted(map(tuple, suffix_dedup.digests(df, window).collect())) == want
        dealt = {}
        for t in texts:
            raw = np.frombuffer(t.encode(), np.uint8)
            for key, _, first, last, place in zip(*suffix_dedup.anchors(raw, np.array([0, len(raw)]), window), strict=True):
                for name, a, b in suffix_dedup.parts(raw, int(first), int(last), int(place), window) if limit == 1 else [(int(key), int(first), int(last))]:
                    dealt.setdefault(name, set()).add(raw[a : b + window].tobytes())
        largest.append(max(map(len, dealt.values())))
    assert window == 40 or largest[1] * 3 < largest[0]


def test_sorting_with_queues_in_files_finds_the_same():
    pieces = sorted({t.encode() for t in licence_rows() if len(t) >= 200})
    one, two = (suffix_dedup.repeated(pieces, [1] * len(pieces), 200, spill) for spill in (None, 50))
    assert all((a == b).all() for a, b in zip(one, two, strict=True)) and any(a.any() for a in one)


def test_distinct_keeps_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    one, two, three, four, five = (text() for _ in range(5))
    rows = [(7, one), (7, two), (None, three), (None, three), (None, four), (9, four), (3, one), (5, five), (5, five)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in near_dup.distinct(df).collect()))
    assert kept == sorted([(False, 3, one), (False, 7, two), (True, 0, three), (True, 0, four), (False, 5, five)])


def test_most_frequent_rows_are_whole_classes_within_the_bound(spark):
    df = spark.createDataFrame([(i, 1000 if i < 5 else 100 if i < 12 else i % 3) for i in range(200)], "k bigint, n bigint")
    kept = lambda most: sorted(r["k"] for r in common.most_frequent(df, "n", most).collect())
    assert kept(4) == [] and kept(5) == kept(11) == list(range(5)) and kept(12) == list(range(12))
    assert len(kept(1000)) == 12 + sum(i % 3 > 0 for i in range(12, 200)) and kept(0) == []


def test_rows_of_files_keep_their_numbers_however_they_are_split(spark, tmp_path):
    spark.range(0, 5000, 1, 7).withColumn("_path", F.lit("x")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where("id % 3 <> 1").select("id", "_path")
    one = dict(common.numbered(df, "number").select("id", "number").collect())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        assert dict(common.numbered(df, "number").select("id", "number").collect()) == one
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(set(one.values())) == len(one) == df.count()
    other = common.numbered(df.groupBy("id").count(), "number")
    assert dict(other.select("id", "number").collect()) == dict(other.select("id", "number").collect())


def test_running_sums_of_long_arrays(spark):
    xs = [list(range(1000)), [], [5], None]
    df = spark.createDataFrame([(x,) for x in xs], "x array<bigint>")
    got = [r["s"] for r in df.select(common.sums_before(F.col("x")).alias("s")).collect()]
    assert got == [[sum(range(i)) for i in range(1000)], [], [0], []]
