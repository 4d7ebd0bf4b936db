"""Numbers of rows within their page, where a page may hold any share of all rows.

A page of up to HUB_ROWS rows is numbered by one window. Larger ones are hubs: their rows are cut into ranges of
the sort key (Spark samples the keys for that), each of which is about as large, counted and numbered by itself;
a running sum of the counts of a hub's ranges gives what is before each. So no task holds a whole hub, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.staging import materialise

#: Rows of a page from which on it is cut into ranges, and rows of a range, about.
HUB_ROWS = 100_000


def ranked(rows: DataFrame, page: list[str], order: list[str | Column], into: str = "position", hub_rows: int | None = None, counts: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """rows with into, the place (from 1) of each in its page by order, a list of columns of rows.

    counts has page and n, the number of rows of each page (at least), if that can be had more cheaply than by reading rows; without
    it rows are written once and counted. Rows that are equal in order may be numbered either way, with dense they
    get one number; nulls come first.
    """
    hub_rows, written = hub_rows or HUB_ROWS, counts is None
    if written:
        rows = materialise(rows, "to-rank")
        counts = rows.groupBy(*page).agg(F.count("*").alias("n"))
    number = F.dense_rank if dense else F.row_number
    plain = number().over(W.partitionBy(*page).orderBy(*order)).cast("long")
    hubs = materialise(counts.where(F.col("n") > hub_rows).select(*page, "n"), "hubs")
    held = hubs.agg(F.sum("n")).first()[0]
    if not held:
        return rows.withColumn(into, plain)
    rows = rows if written else materialise(rows, "to-rank")  # read three times from here on
    same = lambda other: [rows[c].eqNullSafe(other[c]) for c in page]
    cut = rows.join(hubs, same(hubs), "left_semi").repartitionByRange(int(held) // hub_rows + 1, *page, *order)
    cut = materialise(cut.withColumn("_range", F.spark_partition_id()), "ranges")
    before = W.partitionBy(*page).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    inside = number().over(W.partitionBy(*page, "_range").orderBy(*order))
    placed = cut.withColumn(into, inside)
    counted = placed.groupBy(*page, "_range").agg(F.max(into).alias("_n")) if dense else cut.groupBy(*page, "_range").agg(F.count("*").alias("_n"))
    offsets = counted.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(page)), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = placed.join(offsets, [cut["_range"] == offsets["_of"], *(cut[c].eqNullSafe(offsets[f"_{k}"]) for k, c in enumerate(page))])
    found = found.select(*rows.columns, (F.col(into) + F.col("_before")).cast("long").alias(into))
    return rows.join(hubs, same(hubs), "left_anti").withColumn(into, plain).unionByName(found)
