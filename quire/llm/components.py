"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours, stored so that the
    join back on u can split a node with very many neighbours."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("w"))
                  .select("u", F.least("u", "w").alias("m")), "smallest")


def _count(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): ``root`` is the smallest node of the component, for
    every node that has an edge in ``edges (a, b)``.

    Large-star links every larger neighbour to the smallest one, small-star
    every smaller; the two together shrink any component to a star around
    its smallest node in a number of rounds logarithmic in its size.  Only
    a row count and a checksum reach the driver."""
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"),
                                             F.least("a", "b").alias("v")).distinct(), "edges")
    before = _count(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_smallest(both), "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = stored(large, "large").filter("u <> v")
        joined = large.join(_smallest(large), "u")
        e = stored(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .unionByName(joined.select("u", F.col("m").alias("v")))
                   .filter("u <> v").distinct(), "edges")
        after = _count(e)
        if after == before:
            break
        before = after
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
