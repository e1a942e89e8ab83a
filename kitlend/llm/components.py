"""Connected components of a table of links by alternating large and small
stars: every round is two sums of minima and joins, its edges are written to
the shared folder, where they replace those of the round before, and no list of
neighbours is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitlend.llm.common import Shelf, in_files


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation over edges (u, v), u > v.

    Large: each node links its larger neighbours to its smallest neighbour (or
    itself). Small: each node links its smaller neighbours and itself to the
    smallest of them.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        least = least.select("n", F.least("n", "m").alias("m"))
        out = (both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("n"))
               .select(F.col("v").alias("u"), F.col("m").alias("v")))
    else:
        least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        moved = (edges.join(least, F.col("u") == F.col("n"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        out = moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node of it) for the nodes of links (a, b), which are
    counted first and so best are stored.

    No round makes more edges than it takes, so their files are as many as the edges fill,
    not as the shuffles have partitions. Ends when a round of both stars changes no edge: each component is then a
    star around its smallest node.
    """
    shelf = Shelf()
    edges = shelf.keep(in_files(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), links.count()), "links")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark or not now["n"]:
            break
        mark = now
        edges = shelf.keep(in_files(_star(_star(edges, True), False), now["n"]), "links")
    inner = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return inner.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
