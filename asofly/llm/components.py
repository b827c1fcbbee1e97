"""Connected components of link tables, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.llm.common import stash


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b); nulls and self-links are left out.

    Alternating large-star and small-star rounds: each node's larger (then smaller) neighbours are linked to its smallest
    one, until nothing changes; the number of rounds grows with the logarithm of the longest path, and no limit is set on
    it. Each round cuts its lineage in the shared folder. A hub's neighbours are never gathered in one row; the join that
    looks up their smallest one is split by adaptive execution where a hub makes its partition skewed.
    """
    edges = stash(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct(), "edges")
    before, now = None, ()
    while now != before:
        before = now
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        edges = stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
