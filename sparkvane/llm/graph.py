"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; a component is named by its smallest node.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each is an aggregation to a node's smallest
    neighbour and a join back, so no group of neighbours is ever gathered. Ends when a round changes nothing, which takes
    about as many rounds as the logarithm of a component's size; there is no other limit. Null and repeated links, and
    links of a node with itself, add nothing; no links give no rows.
    """
    edges = stage(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")

    def told(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = told(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        # Large star: an edge's larger end goes to the smallest neighbour of its smaller end.
        large = edges.join(least, edges["v"] == least["w"]).select("u", F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        large = large.filter("u > v").distinct()
        # Small star: the smaller neighbours of a node, and itself, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, large["u"] == low["w"]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
        after_edges = stage(small.filter("u > v").distinct(), "links")
        drop_stage(edges)
        edges, after = after_edges, told(after_edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
