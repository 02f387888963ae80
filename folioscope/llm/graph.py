"""Connected components by alternating large-star and small-star steps.

Edges never leave the executors. Each step is an aggregate and an equality join on
narrow rows whose inputs lie in the shared folder; the number of steps grows with
the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, files_for, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: every node of an edge and the smallest node it reaches. Loops and
    edges with a null end are ignored."""
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialize(pairs, "edges")
    few = files_for(edges.sparkSession, 2 * now.count())  # no step makes more rows than both directions of the edges
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "edges-min", few)
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges-large", few)
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "edges-min", few)
        joined = large.join(lower, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialize(small, "edges", few)
        mark = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        for x in (now, least, large, lower):
            discard(x)
        now = after
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
