"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.scale import settle


def _pointed(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the smallest id among u and all neighbours of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of a link, root being the smallest node of its component.

    Rounds go on until every node points at its root, a logarithmic number of them; each
    round's edges are settled. Null ends, loops and repeated links do not count.
    """
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where(F.col("u") != F.col("v"))
    edges = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _pointed(both).where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).distinct()
        pointed = _pointed(large)
        small = pointed.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = settle(small.unionByName(pointed.select("u", F.col("m").alias("v"))).distinct())
        # Stars only: no node has two roots and no root points on.
        several = small.groupBy("u").count().where("count > 1").select("u")
        chained = small.select("u").join(small.select(F.col("v").alias("u")), "u", "left_semi")
        edges = small
        if several.unionByName(chained).isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
