"""Mixing sources to target weights by systematic sampling (operator 4), in DataFrame operations only.

Each source gets a target number of words; each of its documents is then expected
target / source size times. The documents of a source are laid out in one order, their expected
copies are summed up along it, one offset in [0, 1) is added, and a document is emitted once for
each integer that its stretch crosses. Documents of similar size are neighbours in that order, so
that the words taken differ from the target by little more than one document's size.

The order of a source is (size bin, cell, id, size). A cell holds about CELL_ROWS documents of one
source and bin, however large those are, so ranks are found in many small windows, and only the
cells' counts are summed up for a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import WORD, materialise, text_of, with_text

#: Documents of one source and size bin that are ranked in one window, about.
CELL_ROWS = 4096
#: A multiplier and modulus that spread neighbouring ids over cells.
SPREAD, MODULUS = 2654435761, 2147483648


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def size_bin(size: Column) -> Column:
    """Bins one to two per cent wide: the bit length and the leading seven bits."""
    bits = F.length(F.bin(size))
    return bits * 128 + F.call_function("shiftright", size, F.greatest(bits - 7, F.lit(0))).cast("int")


def targets(totals: DataFrame, cap: int) -> DataFrame:
    """totals (source, weight, source_size; one row for each source) with each source's target.

    All sizes are shared out by weight; a target stops at cap times its source's size, and the
    excess is shared among the others by weight until none is above. Sorted by the share at which
    they stop, the sources that stop come first, so one pass of running sums finds the share.
    """
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = totals.withColumn("most", F.lit(cap).cast("long") * F.col("source_size"))
    x = x.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    x = x.withColumn("share", F.col("left").cast("double") / F.sum("weight").over(after).cast("double"))
    x = x.withColumn("free", F.when(F.col("share") * F.col("weight") <= F.col("most"), F.col("share")))
    x = x.withColumn("share", F.first("free", ignorenulls=True).over(everything))
    return x.select("source", "source_size", F.least(F.col("share") * F.col("weight"), F.col("most").cast("double")).alias("target"))


def source_ranks(sources: DataFrame) -> DataFrame:
    """source, source_size and weight 1, 2, 3, 1, ... by code point of the source, null last."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    return sources.select("source", "source_size", ((rank - 1) % 3 + 1).cast("long").alias("weight"))


def mix(df: DataFrame, cap: int = 3, weights: DataFrame | None = None, seed: str = "", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: str | None = None) -> DataFrame:
    """One row for each row of df: id_col, source, size, source_size, target and copies.

    With carry, the rows of df themselves with copies in a column of that name, whatever the names of the others. copies is how often the mix takes the document (0 to cap); the same input and seed give the
    same copies. weights has source and weight (a positive integer) for each source; without it
    weights are 1, 2, 3 and so on as source_ranks() says. Sources are few enough for one row each
    in a task; documents are not.

    A null source is a source of its own. Null and empty texts have size 0; a source without words
    has target 0 and takes nothing. Rows without an id are dealt to cells by their texts. Rows that repeat an id are
    documents of their own, and identical rows may differ in copies as they stand at different
    places. An empty table gives no rows; other columns are ignored.
    """
    with_text(df, text_col)
    size = word_count(text_of(text_col))
    by_text = F.conv(F.substring(F.md5(text_of(text_col)), 1, 8), 16, 10).cast("long")
    number = F.when(F.col(id_col).isNull(), by_text).otherwise(F.col(id_col).cast("long"))
    rows = df.select(F.col(id_col).alias("id"), number.alias("number"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *([F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.xxhash64(text_of(text_col)).alias("tie")] if carry else []))
    rows = rows if carry else materialise(rows, "sizes")  # whole rows are read twice rather than written once more
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).withColumn("bin", size_bin(F.col("size")))
    bins = rows.groupBy("key", "bin").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("words"))
    totals = bins.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    if weights is None:
        weighted = source_ranks(totals)
    else:
        given = weights.select(F.col("source").alias("given"), F.col("weight").cast("long").alias("weight"))
        weighted = totals.join(given, F.col("source").eqNullSafe(F.col("given"))).select("source", "source_size", "weight")
    plan = targets(weighted, cap).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).drop("source")
    plan = bins.select("key", "bin", F.ceil(F.col("n") / CELL_ROWS).alias("cells")).join(plan, "key")
    rows = rows.join(plan, ["key", "bin"])
    spread = F.pmod(F.col("number"), F.lit(MODULUS)) * F.lit(SPREAD)
    rows = rows.withColumn("cell", F.shiftright(spread, 15) % F.col("cells"))
    cells = rows.groupBy("key", "bin", "cell").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("key").orderBy("bin", "cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("key", "bin", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    rank = F.row_number().over(W.partitionBy("key", "bin", "cell").orderBy("id", "size", *(["tie"] if carry else [])))
    rows = rows.withColumn("rank", rank).join(cells, ["key", "bin", "cell"])
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("key"))), 1, 4), 16, 10).cast("double") / 65536
    at = F.col("earlier") + F.col("rank")
    copies = F.floor(expected * at + offset) - F.floor(expected * (at - 1) + offset)
    if carry:
        return rows.select("row.*", copies.cast("long").alias(carry))
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


#: The same in DuckDB SQL, with the columns of the registered query.
MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(doc_id, ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT) AS number, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         coalesce('=' || source, 'null') AS key
  FROM documents),
b AS (
  SELECT *, length(bin(size)) * 128 + (size >> greatest(length(bin(size)) - 7, 0)::BIGINT) AS size_bin FROM d),
s AS (
  SELECT source, key, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source, key),
m AS (SELECT *, 3 * source_size AS most FROM s),
f AS (
  SELECT *,
    (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share
  FROM m),
t AS (
  SELECT key, source_size, least((SELECT arg_min(share, (most::DOUBLE / weight, coalesce('0' || source, '1'))) FROM f WHERE share * weight <= most) * weight, most::DOUBLE) AS target
  FROM f),
c AS (
  SELECT b.*, ((((number % {MODULUS}) + {MODULUS}) % {MODULUS} * {SPREAD}) >> 15)
              % ceil(count(*) OVER (PARTITION BY key, size_bin) / {CELL_ROWS}.0)::BIGINT AS cell
  FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY size_bin, cell, doc_id NULLS FIRST, size) AS pos FROM c),
e AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.pos,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS expected,
         ('0x' || substr(md5(r.key), 1, 4))::INT / 65536.0::DOUBLE AS shift
  FROM r JOIN t ON r.key = t.key)
SELECT doc_id, size, source_size, target,
       ((floor(expected * pos + shift) - floor(expected * (pos - 1) + shift)) * size)::BIGINT AS taken
FROM e"""
