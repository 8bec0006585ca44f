"""Connected components of links between long ids, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame) -> DataFrame:
    """(u, v) with each u's least neighbour joined on; the join's sides are stored, so Spark can split hot u."""
    least = stored(links.groupBy("u").agg(F.min("v").alias("m")), "star")
    return links.join(least, "u").withColumn("m", F.least("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every linked id the least id reachable over `links` (a, b), itself included.

    Loops, repeated and reversed links do no harm; null ends are dropped; no links give no rows.
    Every round writes its links to the shared folder; only a count and a checksum reach the
    driver.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = stored(edges.where("a is not null and b is not null and a <> b").distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        large = _star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "links")
        small = _star(large)
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.where("u <> v").distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
