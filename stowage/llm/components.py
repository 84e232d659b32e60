"""Connected components by alternating stars, with every step in a shared table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges`` (a, b) reaches: columns node, component.

    Nodes that reach no smaller one are left out.

    Each round connects all larger neighbours of a node to the smallest one
    (large star), then all smaller ones (small star), until nothing changes;
    the number of rounds grows with the logarithm of the longest path. Nodes
    of many edges meet their minimum through pre-aggregation.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy(F.col("a").alias("m_a")).agg(F.min("b").alias("m")).select("m_a", F.least("m_a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("m_a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large")
        low = large.groupBy(F.col("a").alias("m_a")).agg(F.min("b").alias("m"))
        joined = large.join(low, F.col("a") == F.col("m_a"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("m_a").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        small = materialise(small, "small")
        discard(edges)
        discard(large)
        edges = small
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
