"""Names to entities, and the graph as it is once names are resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.components import components
from factloom.staging import materialise


def alias_key(text: Column) -> Column:
    """What two spellings of a name have in common: upper case, one underscore for each run of other characters."""
    return F.upper(F.trim(F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}]+", "_"), F.lit("_")))


def resolve(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """mentions (surface, ...) with the entity_id that an alias (surface, entity_id) stands for.

    A mention that no alias matches stays, with a null id. An alias that stands for several entities means
    the smallest id.
    """
    known = aliases.groupBy(alias_key(F.col("surface")).alias("key")).agg(F.min("entity_id").alias("entity_id"))
    return mentions.withColumn("key", alias_key(F.col("surface"))).join(known, "key", "left").drop("key")


def aliases_of(aliases: DataFrame) -> DataFrame:
    """Each entity's aliases in one text."""
    return aliases.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("surface")), ", ").alias("aliases"))


def canonical_ids(same: DataFrame) -> DataFrame:
    """entity_id and root of each id that stands for another one, out of pairs (entity_id, stands_for).

    An id that stands for several means the smallest of them. Chains are followed to their end, however long: the root
    is the id that stands for nothing else. Ids that stand for each other in a circle, and those that lead there, mean the
    smallest of them all. Pairs with a null or of an id with itself say nothing.
    """
    known = same.where("entity_id <> stands_for").groupBy("entity_id").agg(F.min("stands_for").alias("stands_for"))
    known = materialise(known, "stands-for")
    found = materialise(components(known.select("entity_id", "stands_for")).toDF("entity_id", "least"), "same-entity")
    ends = found.join(known, "entity_id", "left_anti").select("least", F.col("entity_id").alias("end"))  # one for each chain, none for a circle
    rooted = found.join(ends, "least", "left").select("entity_id", F.coalesce("end", "least").alias("root"))
    return rooted.where("entity_id <> root")


def canonical_facts(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """Facts whose ends are the roots of what they were; a fact whose two ends are one entity says nothing and is left out.

    The columns of facts and their order stay. roots has entity_id and root, once for each id that is not its own root.
    """
    named = facts
    for end in ("subject_id", "object_id"):
        named = named.join(roots.select(F.col("entity_id").alias(end), F.col("root").alias("_root")), end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    return named.where("NOT (subject_id <=> object_id)").select(facts.columns)


def canonical_edges(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between roots: one for each canonical triple, with the number of edges that it was."""
    named = canonical_facts(edges.select("subject_id", "predicate", "object_id"), roots)
    return named.groupBy("subject_id", "predicate", "object_id").agg(F.count("*").alias("merged"))
