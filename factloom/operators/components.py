"""Connected components of a link table, by alternating large and small stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.staging import Rounds

#: Links up to which the minima of a round are broadcast (16 bytes each) instead of shuffled with the links, and parts
#: that so few links are written in.
BROADCAST_LINKS, FEW_PARTS = 100_000, 8


def _large(edges: DataFrame, hint=lambda df: df) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(hint(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, hint=lambda df: df) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(hint(least), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def one_round(edges: DataFrame, few: bool) -> DataFrame:
    """Both moves of a round. Where links are few, minima are broadcast: links are then shuffled once, when repeats are dropped."""
    if few:
        return _small(_large(edges, F.broadcast), F.broadcast).distinct().coalesce(FEW_PARTS)
    return _small(_large(edges).distinct()).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root of each node of links (two columns of one type that can be ordered); root is the smallest node of its component.

    Each round moves a node's links to its smallest neighbour, once for its larger and once for its
    smaller neighbours, until every node is linked with its root alone. Links are written to the shared
    folder after each round, and those of the round before deleted; minima are taken before the shuffle and no
    neighbourhood is gathered. The rounds end when nothing moves any more, which takes about the logarithm of the longest path.
    Links of a node with itself and nulls are left out, repeated links do no harm.
    """
    u, v = links.columns
    rounds = Rounds(links.sparkSession, "links")
    edges = rounds.write(links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v"))
    mark = (edges.count(), None)
    while mark[0]:
        edges = rounds.write(one_round(edges, mark[0] <= BROADCAST_LINKS))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
