"""The relational tables, and the evidence graph's views over them.

entity   entity_id, name, kind, types, nation
edge     subject_id, predicate, object_id
fact     subject_id, predicate, object_id, order_key, line, when_raw, amount_cents, confidence, snippet_id
snippet  snippet_id, text, source

Each view is built from column expressions, so that filters and column choices reach the scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Factors that spread order lines over all documents as their snippets.
SPREAD_ORDER, SPREAD_LINE = 31, 7

#: Predicate codes with their labels; a code without one is shown as it is.
PREDICATES = {
    "LOCATED_IN": "located in",
    "IN_REGION": "part of",
    "ORDERED": "ordered",
}
DEFAULT_PREDICATE = "linked"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref(kind: str, key: str | Column) -> Column:
    """The id of an entity: its kind and the key it has in its table."""
    return F.concat(F.lit(f"{kind}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kind(name: str, key: str, shown: str, also: Column, nation: Column) -> DataFrame:
        types = F.when(also, F.array(F.lit(name), F.lit("club"))).otherwise(F.array(F.lit(name)))
        return table(spark, sf_dir, name).select(ref(name, key).alias("entity_id"), F.col(shown).alias("name"), F.lit(name).alias("kind"), types.alias("types"), nation.cast("int").alias("nation_key"))

    none = F.lit(None)
    parts = [
        kind("customer", "c_custkey", "c_name", F.col("c_acctbal") < 0, F.col("c_nationkey")),
        kind("supplier", "s_suppkey", "s_name", F.col("s_acctbal") < 0, F.col("s_nationkey")),
        kind("part", "p_partkey", "p_name", F.col("p_size") > 45, none),
        kind("nation", "n_nationkey", "n_name", F.lit(False), none),
        kind("region", "r_regionkey", "r_name", F.lit(False), none),
    ]
    return reduce(DataFrame.unionByName, parts)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two facts for each order line: the customer ordered the part, the supplier supplies it.

    A line's facts cite one of all documents, by its number modulo the largest id; some cite an id that no document has.
    """
    documents = table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("n")).scalar()
    # numbers are made before lines are shuffled, texts after it
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        "l_partkey",
        "l_suppkey",
        F.col("l_linenumber").alias("line"),
        F.to_date("l_shipdate").alias("day"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount_cents"),
        (F.col("l_linestatus") == "F").alias("exact"),
    )
    lines = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("order_key") == F.col("o_orderkey"))
    ends = F.array(F.struct(ref("customer", "o_custkey").alias("subject_id"), F.lit("ORDERED").alias("predicate")), F.struct(ref("supplier", "l_suppkey").alias("subject_id"), F.lit("SUPPLIES").alias("predicate")))
    return lines.select(
        F.inline(ends),
        ref("part", "l_partkey").alias("object_id"),
        "order_key",
        "line",
        F.date_format("day", "yyyy-MM-dd").alias("when_raw"),
        "amount_cents",
        F.when(F.col("exact"), "exact").otherwise("probable").alias("confidence"),
        F.pmod(F.col("order_key") * SPREAD_ORDER + F.col("line") * SPREAD_LINE, documents).cast("long").alias("snippet_id"),
    )


def fact_count(spark: SparkSession, sf_dir: str) -> int:
    """How many facts there are, at most, by the number of order lines."""
    return 2 * table(spark, sf_dir, "lineitem").count()


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of places."""
    located = [table(spark, sf_dir, t).select(ref(t, k).alias("subject_id"), F.lit("LOCATED_IN").alias("predicate"), ref("nation", n).alias("object_id")) for t, k, n in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey"))]
    nations = table(spark, sf_dir, "nation").select(ref("nation", "n_nationkey").alias("subject_id"), F.lit("IN_REGION").alias("predicate"), ref("region", "n_regionkey").alias("object_id"))
    return reduce(DataFrame.unionByName, [*located, nations])


def edges(spark: SparkSession, sf_dir: str, from_facts: DataFrame | None = None) -> DataFrame:
    """The distinct edges of facts (those of the tables, if none are given), and those of places."""
    given = facts(spark, sf_dir) if from_facts is None else from_facts
    return places(spark, sf_dir).unionByName(given.select("subject_id", "predicate", "object_id").distinct())


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as snippets."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("snippet_id"), "text", F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.col("doc_id").cast("string")).alias("source_url"))


def predicate_labels(spark: SparkSession) -> DataFrame:
    """code and label; a table of a few fixed rows."""
    return spark.createDataFrame(list(PREDICATES.items()), "code string, label string")


#: The same views as DuckDB common table expressions.
VIEWS_SQL = f"""
entity AS (
  SELECT 'customer:' || c_custkey AS entity_id, c_name AS name, 'customer' AS kind, CASE WHEN c_acctbal < 0 THEN ['customer', 'club'] ELSE ['customer'] END AS types, c_nationkey AS nation_key FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier', CASE WHEN s_acctbal < 0 THEN ['supplier', 'club'] ELSE ['supplier'] END, s_nationkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part', CASE WHEN p_size > 45 THEN ['part', 'club'] ELSE ['part'] END, NULL FROM part
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation', ['nation'], NULL FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, r_name, 'region', ['region'], NULL FROM region),
line AS (SELECT *, 'part:' || l_partkey AS object_id, l_orderkey AS order_key, l_linenumber AS line, strftime(l_shipdate, '%Y-%m-%d') AS when_raw,
    round(l_extendedprice * 100)::BIGINT AS amount_cents, CASE WHEN l_linestatus = 'F' THEN 'exact' ELSE 'probable' END AS confidence,
    ((l_orderkey * {SPREAD_ORDER} + l_linenumber * {SPREAD_LINE}) % (SELECT max(doc_id) + 1 FROM documents))::BIGINT AS snippet_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fact AS (
  SELECT 'customer:' || o_custkey AS subject_id, 'ORDERED' AS predicate, object_id, order_key, line, when_raw, amount_cents, confidence, snippet_id FROM line
  UNION ALL SELECT 'supplier:' || l_suppkey, 'SUPPLIES', object_id, order_key, line, when_raw, amount_cents, confidence, snippet_id FROM line),
edge AS (
  SELECT 'customer:' || c_custkey AS subject_id, 'LOCATED_IN' AS predicate, 'nation:' || c_nationkey AS object_id FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'LOCATED_IN', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'IN_REGION', 'region:' || n_regionkey FROM nation
  UNION ALL (SELECT DISTINCT subject_id, predicate, object_id FROM fact)),
snippet AS (SELECT doc_id AS snippet_id, text, 'https://' || source || '.example/' || doc_id AS source_url FROM documents),
label AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in PREDICATES.items())}) AS t(code, label))
"""
