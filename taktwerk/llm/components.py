"""Connected components of a table of links, by alternating star operations.

Each round ties every node to the smallest of its neighbours (first those above it, then
itself with those below), which leads to stars after a number of rounds that grows with
the logarithm of the longest path.  Nothing but a flag comes to the driver, every round starts
from written files, and the minima are written tables, so that Spark can split the rows of a
node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.llm.common import materialize, merged, scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star-min")
    return merged(both.where("v > u"), least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("hi").agg(F.min("lo").alias("m")), "small-star-min")
    below = merged(edges, least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return below.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (64-bit numbers) but the roots themselves;
    a root is the smallest number of its component.

    Links of a node with itself and repeated links have no effect; a link with a null is none.
    """
    with scratch(links.sparkSession) as keep:
        pairs = links.where("a <> b")
        edges = materialize(pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
        while True:
            # Stars: no node is both above one node and below another.
            sides = edges.select(F.col("hi").alias("node"), F.lit(1).alias("side")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(2).alias("side")))
            if sides.groupBy("node").agg(F.bit_or("side").alias("sides")).where("sides = 3").isEmpty():
                if edges.groupBy("hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
                    return keep(edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")), "components")
            edges = materialize(_small_star(materialize(_large_star(edges), "large-star")), "small-star")
