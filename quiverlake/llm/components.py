"""Connected components of a table of links, never gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.common import cut


def components(links: DataFrame) -> DataFrame | None:
    """node, root (the smallest node it reaches) of links (a, b); None without links.

    Large-star and small-star turns: each links a node's neighbours with the smallest of them,
    until nothing changes; the rounds grow with the logarithm of the longest path. links is read
    several times, so it is best a checkpoint.
    """
    edges = links.where("a <> b").select("a", "b")
    if edges.isEmpty():
        return None
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = cut(large.distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x")).select("x.a", "x.b")
        edges = cut(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(edges.select("b", "b").distinct()).dropDuplicates(["node"])
