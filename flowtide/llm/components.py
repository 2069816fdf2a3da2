"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowtide.plans.materialise import materialise, materialise_with


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``node, root``: for every node of an edge, the smallest node it is connected to.

    Rounds of large-star and small-star steps: each node's neighbours are linked to the smallest of
    them, until every node is linked to its root alone.  The minima are map-side aggregates and
    are written before the join, so that a hub, as the root of a large component is, can be
    split between tasks like any skewed key.  A few rounds suffice (the logarithm of a component's
    size); each round's edges are a written table.
    """
    now = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # Large star: neighbours above a node go to the smallest of its neighbours and itself.
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where(F.col("u") != F.col("v")).distinct(), "large")
        # Small star: a node and its smaller neighbours go to the smallest of those.
        small_least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(small_least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v")
        now, facts = materialise_with(
            small.where(F.col("u") != F.col("v")).distinct(),
            "edges",
            rows=F.count(F.lit(1)),
            mix=F.bit_xor(F.xxhash64("u", "v")),
        )
        if facts == before:
            break
        before = facts
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
