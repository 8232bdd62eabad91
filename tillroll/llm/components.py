"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, component: long), the component being
    the smallest node reachable. Nodes without a link to another are absent.

    Each round points every larger neighbour of a node at the smallest of its
    neighbourhood, then every node at its smallest neighbour. Links only ever
    move to smaller nodes, so a round keeps at most one link a link, and the
    number of rounds grows with the logarithm of the longest chain. All
    neighbourhoods are reduced to minima before the shuffle; none is collected.
    Self links and null ends are ignored; an empty table gives an empty one.
    """
    e = cut_lineage(links.where(F.col("a") != F.col("b"))
                    .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct())
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (e.join(low, e.b == low.u).select("a", F.col("m").alias("b"))
                 .where(F.col("a") != F.col("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = (large.join(least, large.a == least.u)
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a"), F.col("m").alias("b")))).alias("x"))
                 .select("x.a", "x.b").where(F.col("a") != F.col("b")).distinct())
        e = cut_lineage(small)
        # done when every node has one target and no target has a link of its own; a
        # node with two targets joins their components in the next round
        ends = e.select("a", "b", F.lit(0).alias("t")).unionByName(
            e.select(F.col("b").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(1).alias("t")))
        open_nodes = (ends.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max("t").alias("t"))
                      .where(F.col("low").isNotNull() & ((F.col("low") < F.col("high")) | (F.col("t") == 1))))
        if open_nodes.isEmpty():
            break
    # one link a node is left, and every target is a component's smallest node
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots)
