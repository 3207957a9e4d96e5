"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction. `edges` holds each link once as (u, v) with u > v.

    Each node hands its neighbours (small: those below it, and itself) to the least node it sees. The
    least node is a map-side reduced minimum; links of a busy node are joined to that one row, so AQE
    can split them, and no neighbour list is built.
    """
    sides = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node of its component.

    `links` has columns a and b (null ends and loops are ignored, repeated links do no harm). Rounds go
    on until nothing changes; their number grows with the logarithm of a component's size. Each round
    writes its links to the shared checkpoint folder, and only a count and a checksum reach the driver.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(edges)
    while True:
        edges = cut(_stars(_stars(edges, small=False), small=True))
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
