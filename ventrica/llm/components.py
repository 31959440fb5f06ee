"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations with partial sums and two equi-joins; nothing is
collected, and each round is written to the shared folder, so a lost executor costs at
most one round. A node with very many links is only a skewed join key, which adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the smallest node reachable.

    Null ends and self-loops are ignored; repeated and reversed edges count once; no edges
    give no rows.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = materialize(e, tag), None
    while True:
        # one scan tells whether the last round changed anything
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # written, as the small stars read it three times, and a plan that holds it so often weighs on the driver in every round
        large = materialize(large.where("u <> v").distinct(), tag)
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        old, e = e, materialize(small.distinct(), tag)
        for done in (old, large):
            discard(done)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
