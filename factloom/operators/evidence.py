"""Facts, the snippets they cite and the numbers of their footnotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import escape, qualifiers, quoted_in
from factloom.operators.ranking import ranked
from factloom.staging import materialise

#: Grades of confidence, the surest last.
GRADES = ["probable", "exact"]

#: The order of the facts under a heading, after their grade: by time.
FACT_ORDER = ["confidence", "when_raw", "order_key", "line", "amount_cents"]


def doubt() -> Column:
    """The place of a fact's grade, the surest first; a grade that is not known comes last."""
    place = F.array_position(F.array(*map(F.lit, reversed(GRADES))), F.col("confidence"))
    return F.when(place > 0, place).otherwise(len(GRADES) + 1).alias("doubt")


def edge_facts(facts: DataFrame) -> DataFrame:
    """One row for each edge: its facts as one sorted array, their number and total."""
    entry = F.struct(doubt(), *FACT_ORDER)
    return facts.groupBy("subject_id", "predicate", "object_id").agg(F.count("*").alias("n_facts"), F.sum("amount_cents").alias("total_cents"), F.array_sort(F.collect_list(entry)).alias("facts"))


def at_least(facts: DataFrame, grade: str) -> DataFrame:
    """Facts of that grade of confidence or a surer one."""
    rank = F.array_position(F.array(*map(F.lit, GRADES)), F.col("confidence"))
    return facts.where(rank >= GRADES.index(grade) + 1)


def with_qualifiers(facts: DataFrame) -> DataFrame:
    """Facts with their qualifiers as one text, in fixed order, without those that are missing."""
    amount = F.when(F.col("amount_cents") >= 1_000_000, F.concat(F.lit("$"), F.floor(F.col("amount_cents") / 100).cast("string")))
    return facts.withColumn("shown", qualifiers("when_raw", amount, F.when(F.col("confidence") != "exact", F.col("confidence"))))


def cited(facts: DataFrame, snippets: DataFrame) -> DataFrame:
    """Facts with the address of their snippet's source; facts without a snippet stay."""
    return facts.join(snippets.select("snippet_id", "source_url"), "snippet_id", "left")


def footnotes(facts: DataFrame, hub_rows: int | None = None) -> DataFrame:
    """page_id, snippet_id, number and uses: each page's snippets numbered in the order of first use.

    A snippet's first place is found by aggregation, so only one row for each page and snippet is sorted.
    Pages of more than hub_rows snippets are numbered in ranges.
    """
    order = F.struct("object_id", doubt(), *FACT_ORDER)
    first = facts.groupBy(F.col("subject_id").alias("page_id"), "snippet_id").agg(F.min(order).alias("first"), F.count("*").alias("uses"))
    return ranked(first, ["page_id"], ["first", "snippet_id"], "number", hub_rows).select("page_id", "snippet_id", "number", "uses")


def numbered(facts: DataFrame, hub_rows: int | None = None) -> DataFrame:
    """Facts with their page's number for the snippet, and a back link that no other fact of the page has.

    Facts are read twice, so they should be a written table.
    """
    notes = materialise(footnotes(facts, hub_rows), "footnotes").withColumnRenamed("page_id", "subject_id")
    found = facts.join(notes, ["subject_id", "snippet_id"])
    sizes = notes.select("subject_id", "snippet_id", F.col("uses").alias("n"))
    found = ranked(found, ["subject_id", "snippet_id"], ["object_id", doubt(), *FACT_ORDER], "use", hub_rows, sizes)
    return found.withColumn("back_link", F.format_string("fnref-%d-%d", F.col("number"), F.col("use"))).drop("uses", "use")


def quote_check(quotes: DataFrame, snippets: DataFrame) -> DataFrame:
    """quote_id, snippet_id and found: whether each part of a quotation stands in its own snippet."""
    found = quotes.join(snippets.select("snippet_id", "text"), "snippet_id", "left")
    return found.select("quote_id", "snippet_id", F.coalesce(quoted_in(F.col("quote"), F.col("text")), F.lit(False)).alias("found"))


def last_change(facts: DataFrame) -> DataFrame:
    """Each page's last date."""
    return facts.groupBy(F.col("subject_id").alias("page_id")).agg(F.max("when_raw").alias("updated"))


def source_lines(facts: DataFrame, snippets: DataFrame, hub_rows: int | None = None) -> DataFrame:
    """page_id, number and line: each page's sources as escaped markup."""
    notes = footnotes(facts, hub_rows).join(snippets.select("snippet_id", "source_url"), "snippet_id", "left")
    return notes.select("page_id", "number", F.format_string('<li id="fn-%d">%s</li>', F.col("number"), escape(F.coalesce("source_url", F.lit("")))).alias("line"))


def source_list(facts: DataFrame, snippets: DataFrame) -> DataFrame:
    """Each page's sources as one text of escaped markup, in the order of their numbers."""
    lines = F.array_sort(F.collect_list(F.struct("number", "line")))
    return source_lines(facts, snippets).groupBy("page_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("sources"), F.count("*").alias("n_sources"))
