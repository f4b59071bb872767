"""What makes drawn scores quick: texts are hashed many at once, and ranks take one window."""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerline.functions import columns, hashing
from ledgerline.operators import ranking


def test_many_hashes_are_md5():
    texts = [f"20260912|{d}|{k}|bal" for d in (0, 17) for k in range(1, 2000, 7)] + ["", "x" * 53, "x" * 54, "y" * 200, "é" * 27]
    column = pa.array(["cut off", *texts])[1:]
    for end, got in zip(("|a", "|b", ""), hashing.text_bits(column, "|a", "|b", ""), strict=True):
        assert got.tolist() == [int(hashlib.md5((t + end).encode()).hexdigest()[:13], 16) for t in texts]
    assert hashing.text_bits(column[:0], "|a")[0].tolist() == []


def test_noise_follows_the_hashes_of_its_definition(spark):
    key = (F.lit(20260912), F.col("id"), F.lit("bal"))
    u, v = columns.hash_uniform(*key, F.lit("a")), columns.hash_uniform(*key, F.lit("b"))
    plain = F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * 3.141592653589793) * v)
    df = spark.range(3000).select(columns.hash_normal(*key).alias("z"), plain.alias("w"))
    assert df.where("z <> w or z is null").count() == 0
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()


def test_a_rank_is_one_window(spark):
    """Three windows held every group's rows three times over."""
    df = spark.range(100).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).alias("g"))
    plan = ranking.percentile_ranks(df, {"x": "p"}, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" +-:").startswith("Window ") for line in plan.splitlines()) == 1


def test_bounds_are_joined_once_for_both_scores(spark):
    from ledgerline.operators import scoring

    df = spark.range(400).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 > 0, (F.col("id") * 37 % 101).cast("double")).alias("x"))
    both = scoring.winsor_scores(df, "x", ["g"], "z", "m")
    apart = scoring.min_max(scoring.winsor_z(df, "x", ["g"], "z"), "x", ["g"], "m")
    assert sorted(both.select("id", "z", "m").collect()) == sorted(apart.select("id", "z", "m").collect())
    joins = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert 2 * joins(both) == joins(apart)
