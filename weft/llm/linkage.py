"""Connected components of links, by alternating large-star and small-star steps.

Every step is a few shuffles of the links; nothing is collected but a count and a checksum. A node's
least neighbour comes from a partial aggregation, and meets the node's links in a join, whose keys
adaptive execution can split: no task holds all links of a hub. Each round's links are written to
the shared folder, so that lineage stays short; rounds go on until nothing changes, which the steps
reach after some logarithm of the longest path, squared at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import discard, materialize


def _least(e: DataFrame) -> DataFrame:
    """e with m, the least b of each a."""
    return e.join(e.groupBy("a").agg(F.min("b").alias("m")), "a")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """e has a > b. Each node's smaller neighbours, and itself, get the least of them."""
    pairs = F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))
    return _least(e).select(F.explode(pairs).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a > b")


def components(links: DataFrame) -> DataFrame:
    """node, comp for every node of links (columns a, b) but the least of each component."""
    e = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    e, state = materialize(e, "links"), None
    while True:
        new = materialize(_small_star(_large_star(e).distinct()).distinct(), "links")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum("b")).first()
        discard(e)
        e = new
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        state = now
