"""Shortest paths from a set of pages to all others, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import neighbours
from factloom.staging import materialise


def least_paths(edges: DataFrame, starts: DataFrame, farthest: int | None = None) -> DataFrame:
    """node, distance, parent and path of each page that can be reached from starts (entity_id), along edges in either direction.

    path is an array of ids from a start to the node; of all shortest paths it is the least in the order of its ids, so
    parent, the id before the last, and the start are settled too. farthest ends the search after that many links; without
    it it ends when a level is empty.

    Each level is one join of the pages found last with the neighbours of all, of which partial minima are taken before
    the shuffle, and is written before the next. A neighbour of a level lies in it, in the one before or in the one after, so
    pages found already are told by the last two levels and not by all. A start that no edge touches is reached at
    distance 0; starts that repeat count once, nulls not at all.
    """
    links = materialise(neighbours(edges), "neighbours")
    found = starts.select(F.col("entity_id").alias("node")).where("node IS NOT NULL").distinct()
    level = materialise(found.select("node", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent"), F.array("node").alias("path")), "level")
    levels = [level]
    while not level.isEmpty() and (farthest is None or len(levels) <= farthest):
        step = level.select(F.col("node").alias("page_id"), "path").join(links, "page_id").select(F.col("other_id").alias("node"), "path")
        near = reduce(DataFrame.unionByName, [x.select("node") for x in levels[-2:]])
        step = step.join(near, "node", "left_anti").groupBy("node").agg(F.min("path").alias("before"))
        step = step.select("node", F.lit(len(levels)).alias("distance"), F.element_at("before", -1).alias("parent"), F.concat("before", F.array("node")).alias("path"))
        level = materialise(step, "level")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)
