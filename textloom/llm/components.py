"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize


def connect(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, keep): every node that isn't the smallest of its component, and that one.

    Alternating large-star and small-star: in the large-star step a node links its larger
    neighbours to its smallest neighbour (or itself), in the small-star step it links its
    smaller neighbours and itself. The edges become stars in O(log**2) rounds, and no round
    makes more edges than it had. Each round is written, so that lineage stays short.
    Nulls and self-loops are ignored; the order of a and b doesn't matter.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = materialize(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(low, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v")))
                 .filter("u <> v").distinct())
        e = materialize(small, "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("keep"))
        before = state
