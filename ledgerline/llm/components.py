"""Connected components of a table of edges, by large-star and small-star rounds.

The edges stay a distributed table, written to the shared folder after every step, and
only their number and a change flag reach the driver.  Every vertex's least neighbour comes
from an aggregation with partial minima and is stored; edges are joined to that table,
which has one row a vertex, so that the edges of a hub are split over tasks (Spark's
skewed joins need both sides straight from a shuffle or a table).  Edges should lead to the
least vertex of their group where the caller can choose: a hub is least then, and the second
step has few rows for any vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored_alone as stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """vertex and component (the smallest vertex that edges reach) of every vertex of edges (a, b)."""
    labels = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct()
    labels = stored(labels, f"{name}-0")
    k = 0
    while True:
        k += 1
        # Large star: every larger neighbour of x is linked to the least of x and its neighbours.
        both = labels.union(labels.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m"))
        least = stored(least.select("v", F.least("v", "m").alias("m")), f"{name}-least")
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # Small star: x and its smaller neighbours are linked to the least of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        after = stored(small, f"{name}-{k}")
        # Done when every vertex has one edge, to a vertex that has none upwards.
        n, vertices = after.agg(F.count(F.lit(1)), F.countDistinct("v")).first()
        chained = after.select(F.col("u").alias("v")).join(after.select("v").distinct(), "v", "left_semi").limit(1).count()
        labels = after
        if n == vertices and not chained:
            break
    roots = labels.select(F.col("u").alias("vertex")).distinct()
    return labels.select(F.col("v").alias("vertex"), F.col("u").alias("component")).union(roots.select("vertex", F.col("vertex").alias("component")))
