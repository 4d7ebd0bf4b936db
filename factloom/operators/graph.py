"""Edges, neighbours and their order.

Edges are (subject_id, predicate, object_id), entities have entity_id, name and types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import colour
from factloom.operators.ranking import ranked
from factloom.sources.tables import DEFAULT_PREDICATE


def edges_out(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Each entity with the edges that it is the subject of."""
    return entities.select("entity_id", "name").join(edges.withColumnRenamed("subject_id", "entity_id"), "entity_id")


def edges_in(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Each entity with the edges that it is the object of."""
    return entities.select("entity_id", "name").join(edges.withColumnRenamed("object_id", "entity_id"), "entity_id")


def both_ends(edges: DataFrame) -> DataFrame:
    """page_id, direction, predicate and other_id: each edge as seen from its two ends, in one scan of the edges."""
    out = F.struct(F.col("subject_id").alias("page_id"), F.lit("out").alias("direction"), F.col("object_id").alias("other_id"))
    back = F.struct(F.col("object_id").alias("page_id"), F.lit("in").alias("direction"), F.col("subject_id").alias("other_id"))
    return edges.select("predicate", F.inline(F.array(out, back))).select("page_id", "direction", "predicate", "other_id")


def with_ends(edges: DataFrame, entities: DataFrame, red: str) -> DataFrame:
    """Edges with the names and colours of both ends; an end without an entity keeps its id as a name."""
    named = entities.select("entity_id", "name", colour(F.col("types"), red).alias("colour"))
    subject = named.select(F.col("entity_id").alias("subject_id"), F.col("name").alias("subject_name"), F.col("colour").alias("subject_colour"))
    target = named.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object_name"), F.col("colour").alias("object_colour"))
    found = edges.join(subject, "subject_id", "left").join(target, "object_id", "left")
    return found.select("subject_id", F.coalesce("subject_name", "subject_id").alias("subject_name"), F.coalesce("subject_colour", F.lit("green")).alias("subject_colour"), "predicate", "object_id", F.coalesce("object_name", "object_id").alias("object_name"), F.coalesce("object_colour", F.lit("green")).alias("object_colour"))


def neighbours(edges: DataFrame) -> DataFrame:
    """page_id and other_id, once for each pair whatever the number and direction of its edges."""
    return both_ends(edges).select("page_id", "other_id").distinct()


def neighbour_bar(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Each page's neighbours in the order of their lower-cased names, as one text, and their number."""
    return bar_of(neighbours(edges), entities)


def bar_of(near: DataFrame, entities: DataFrame) -> DataFrame:
    """The same from pages and their neighbours."""
    named = near.join(entities.select(F.col("entity_id").alias("other_id"), "name"), "other_id", "left").withColumn("name", F.coalesce("name", "other_id"))
    bar = F.array_sort(F.collect_list(F.struct(F.lower("name").alias("key"), "other_id", "name")))
    return named.groupBy("page_id").agg(F.array_join(F.transform(bar, lambda x: x["name"]), " · ").alias("bar"), F.count("*").alias("n"))


def ranked_neighbours(edges: DataFrame, entities: DataFrame, hub_rows: int | None = None) -> DataFrame:
    """page_id, other_id, name and position: each page's neighbours numbered in the order of their lower-cased names."""
    named = neighbours(edges).join(entities.select(F.col("entity_id").alias("other_id"), "name"), "other_id", "left").withColumn("name", F.coalesce("name", "other_id"))
    return ranked(named, ["page_id"], [F.lower("name"), "other_id"], hub_rows=hub_rows, counts=page_sizes(both_ends(edges)))


def page_sizes(sides: DataFrame) -> DataFrame:
    """page_id and n, the number of headings of each page."""
    return sides.groupBy("page_id").agg(F.count("*").alias("n"))


def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the label of their predicate: the code where there is none, a default where there is no code."""
    small = F.broadcast(labels)  # the vocabulary, a few fixed rows
    return edges.join(small, edges["predicate"] == small["code"], "left").select(*edges.columns, F.coalesce("label", "predicate", F.lit(DEFAULT_PREDICATE)).alias("label"))


def sections(edges: DataFrame, entities: DataFrame, labels: DataFrame, hub_rows: int | None = None) -> DataFrame:
    """Each page's headings in order: outgoing first, then by the neighbour's lower-cased name and the label.

    edges are read more than once, so they should be a written table. Pages of more than hub_rows headings are numbered in ranges.
    """
    return sections_of(both_ends(edges), entities, labels, hub_rows)


def sections_of(sides: DataFrame, entities: DataFrame, labels: DataFrame, hub_rows: int | None = None) -> DataFrame:
    """The same from edges as seen from their two ends."""
    return ranked(headings(sides, entities, labels), ["page_id"], heading_order(), hub_rows=hub_rows, counts=page_sizes(sides)).select("page_id", "position", "direction", "label", "other_id", "name")


def headings(sides: DataFrame, entities: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges as seen from their two ends, with the name of the other end and the label."""
    return labelled(sides, labels).join(entities.select(F.col("entity_id").alias("other_id"), "name"), "other_id", "left").withColumn("name", F.coalesce("name", "other_id"))


def heading_order() -> list[str | Column]:
    """The order of a page's headings."""
    return [F.when(F.col("direction") == "out", 0).otherwise(1), F.lower("name"), "label", "other_id"]


def with_places(sides: DataFrame, entities: DataFrame, labels: DataFrame, hub_rows: int | None = None) -> DataFrame:
    """Headings with their position on the page, and with the place of the other end among the page's neighbours, the same in all
    headings of one neighbour. Pages are shuffled once for both."""
    counts = page_sizes(sides)
    placed = ranked(headings(sides, entities, labels), ["page_id"], heading_order(), "position", hub_rows, counts)
    return ranked(placed, ["page_id"], [F.lower("name"), "other_id"], "place", hub_rows, counts, dense=True)


def without_edges(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that no edge touches."""
    ends = both_ends(edges).select(F.col("page_id").alias("entity_id"))
    return entities.join(ends, "entity_id", "left_anti")


def without_edge_of(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key no other row holds."""
    return rows.join(others.select(F.col(other_key).alias(key)), key, "left_anti")


def dangling(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Ends of edges that no entity stands for, with the number of headings that link to them."""
    ends = both_ends(edges).select(F.col("other_id").alias("entity_id"))
    return ends.join(entities.select("entity_id"), "entity_id", "left_anti").groupBy("entity_id").agg(F.count("*").alias("links"))


def live(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges both of whose ends have an entity."""
    known = entities.select("entity_id")
    return edges.join(known.withColumnRenamed("entity_id", "subject_id"), "subject_id", "left_semi").join(known.withColumnRenamed("entity_id", "object_id"), "object_id", "left_semi")


def degrees(edges: DataFrame, predicates: list[str]) -> DataFrame:
    """Each page's number of headings, in all and by predicate."""
    counts = both_ends(edges).groupBy("page_id").pivot("predicate", predicates).count().na.fill(0)
    return counts.select("page_id", *predicates, sum((F.col(p) for p in predicates), F.lit(0).cast("long")).alias("degree"))


def two_hops(edges: DataFrame, start: DataFrame) -> DataFrame:
    """start_id and far_id for pages two links from each start and not nearer, with the number of ways."""
    near = neighbours(edges)
    first = near.join(start.select(F.col("entity_id").alias("page_id")), "page_id", "left_semi").select(F.col("page_id").alias("start_id"), F.col("other_id").alias("page_id"))
    second = first.join(near, "page_id").where(F.col("other_id") != F.col("start_id")).groupBy("start_id", F.col("other_id").alias("far_id")).agg(F.count("*").alias("ways"))
    return second.join(first.select("start_id", F.col("page_id").alias("far_id")), ["start_id", "far_id"], "left_anti")


def common_neighbours(edges: DataFrame, one: str, other: str) -> DataFrame:
    """The neighbours that two pages share."""
    near = neighbours(edges)
    return near.where(F.col("page_id") == one).select("other_id").intersect(near.where(F.col("page_id") == other).select("other_id"))


def lost_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges that an older graph has and a newer one has not, as often as they are missing."""
    names = ["subject_id", "predicate", "object_id"]
    return before.select(names).exceptAll(after.select(names))
