"""Connected components of a table of links, by star contraction in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import split_join


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of any comparable type -> (node, root), root the smallest node of the component.

    Each round hangs every node's neighbours on its smallest neighbour
    (larger ones first, then the smaller ones), which halves the depth of the
    forest.  Groups are only ever reduced to a minimum, with partial
    aggregation, and joined back over a splittable join, so a node with very
    many neighbours is no task of its own.  Rounds end when a round changes
    nothing.  Every round is checkpointed in the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    edges = checkpoint(links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or tuple(state) == before:
            return edges.select(a.alias("node"), b.alias("root"))
        before = tuple(state)
        # larger neighbours hang on the smallest neighbour (or the node itself)
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = split_join(edges.select(b.alias("a"), a.alias("v")), least, ["a"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter(a != b).distinct()
        # smaller neighbours and the node itself hang on the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = split_join(large, least, ["a"])
        edges = checkpoint(small.select(b.alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
                           .filter(a != b).distinct())
