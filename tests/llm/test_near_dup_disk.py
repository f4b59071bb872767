"""A text is dealt once for each chunk of its cluster: large clusters are dealt in rounds, which don't lie on disk together."""

import os
import random
import time

from pyspark.sql import functions as F

from ledgerline.llm import near_dup
from ledgerline.llm.common import DROPPED, stored, stored_alone


def test_rounds_find_the_same_links(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = [(k, " ".join([*base[: 100 + k % 7], f"x{rng.randrange(40)}"])) for k in range(60)] + [(100 + k, f"a b c d {k}") for k in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(map(tuple, near_dup.join(docs, 3, 80).collect()))
    dealt, run = [], near_dup._blocks
    monkeypatch.setattr(near_dup, "_blocks", lambda *a: dealt.append(a) or run(*a))
    monkeypatch.setattr(near_dup, "ROUND", 1)
    assert sorted(map(tuple, near_dup.join(docs, 3, 80, chunk=4).collect())) == want
    assert len(dealt) > 5 and max(n for *_, n in want) > 40


def test_shuffles_of_a_stored_table_are_deleted(spark):
    def files():
        local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for top in local for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    def grown(store):
        before, df = files(), spark.range(20_000).withColumn("k", F.col("id") % 7).repartition(4, "k")
        store(df, "alone")
        for _ in range(50):
            if not (own := files() - before):
                return own
            time.sleep(0.1)
        return own

    assert grown(stored) and not grown(stored_alone)
    assert spark.conf.get(DROPPED) == "false"
