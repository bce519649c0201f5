"""Connected components of a table of links, by contracting stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Links in a partition: few links don't take up many tasks and files.
LINKS = 500_000


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of links (a, b); component is its least node.

    Alternates two steps until nothing changes (Kiveris et al., 2014): every
    node hands its larger neighbours to its least one, then its smaller ones.
    Least neighbours come from aggregations that start before the shuffle, so a
    node with very many links costs no more than others. Each round is
    checkpointed; the number of rounds grows with the logarithm of the longest
    chain. No round has more links than the first one.
    """
    edges = scratch.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    few = edges.count() // LINKS + 1
    edges, state = edges.coalesce(few), None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").coalesce(few).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = scratch.keep(small.filter("a <> b").coalesce(few).distinct().coalesce(few))
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
