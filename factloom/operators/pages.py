"""Fields out of raw pages, and pages out of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import colour, escape
from factloom.operators import evidence, graph
from factloom.staging import materialise

#: Shown on a page without edges.
NO_EDGES = "No links are recorded"
#: Lines of a section on one part of a page.
PART_LINES = 10_000


def cleaned(pages: DataFrame) -> DataFrame:
    """Pages without scripts, styles and comments, whose text is not the page's."""
    html = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    return pages.withColumn("html", html)


def titles(pages: DataFrame) -> DataFrame:
    """page_id, host, language, title and heading of each page."""
    field = lambda pattern: F.trim(F.regexp_extract("html", pattern, 1))
    return cleaned(pages).select(
        "page_id",
        F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"),
        field(r'<html[^>]*\slang="([^"]*)"').alias("lang"),
        field(r"(?s)<title>(.*?)</title>").alias("title"),
        field(r"(?s)<h1[^>]*>(.*?)</h1>").alias("heading"),
    )


def links(pages: DataFrame) -> DataFrame:
    """page_id, position, target and shown of each link, in order."""
    anchors = F.regexp_extract_all("html", F.lit(r'(?s)<a\s+href="[^"]*"\s*>.*?</a>'), F.lit(0))
    found = cleaned(pages).select("page_id", F.posexplode(anchors).alias("position", "anchor"))
    return found.select("page_id", F.col("position").cast("long").alias("position"), F.regexp_extract("anchor", r'href="([^"]*)"', 1).alias("target"), F.trim(F.regexp_extract("anchor", r"(?s)>(.*?)</a>", 1)).alias("shown"))


def plain_text(pages: DataFrame) -> DataFrame:
    """page_id and the text of each page without tags."""
    text = F.regexp_replace(F.regexp_replace("html", "(?s)<[^>]*>", " "), r"[\t\n\r ]+", " ")
    return cleaned(pages).select("page_id", F.trim(text).alias("text"))


def index_counts(entities: DataFrame) -> DataFrame:
    """How many entities each type has; an entity of two types counts for both."""
    return entities.select(F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("entities"))


def file_name(entity_id: Column) -> Column:
    """The name of an entity's page."""
    return F.concat(F.lit("entity-"), F.replace(entity_id, F.lit(":"), F.lit("-")), F.lit(".html"))


def index_list(entities: DataFrame) -> DataFrame:
    """The list of all profiles: type, entity_id, name and file_name, by type and lower-cased name."""
    rows = entities.select(F.explode("types").alias("type"), "entity_id", "name", file_name(F.col("entity_id")).alias("file_name"))
    return rows.orderBy("type", F.lower("name"), "entity_id")


def part_name(entity_id: Column, part: Column) -> Column:
    """The name of a part of an entity's page; the first one has the page's name."""
    more = F.when(part > 1, F.concat(F.lit("-"), part.cast("string"))).otherwise("")
    return F.replace(file_name(entity_id), F.lit(".html"), F.concat(more, F.lit(".html")))


def profiles(entities: DataFrame, edges: DataFrame, facts: DataFrame, snippets: DataFrame, labels: DataFrame, red: str, part_lines: int = PART_LINES, hub_rows: int | None = None) -> DataFrame:
    """entity_id, part, parts, file_name and html of each entity's page, in parts of part_lines lines of a section at most.

    A page has a header, the bar of neighbours, the headings of outgoing and then incoming edges, and the
    numbered sources. A section without content is left out, a page without edges says so. A page whose sections are all
    short is one part; of a hub each part has the header, its place among the parts and its share of each section. So
    no group is larger than a part, whatever an entity's degree. edges and facts are read more than once and should be written tables.
    """
    return profiles_of(entities, entities, graph.both_ends(edges), facts, snippets, labels, red, part_lines, hub_rows)


def profiles_of(entities: DataFrame, named: DataFrame, sides: DataFrame, facts: DataFrame, snippets: DataFrame, labels: DataFrame, red: str, part_lines: int | None = PART_LINES, hub_rows: int | None = None) -> DataFrame:
    """The same from edges as seen from their two ends. sides and facts have the rows of the pages of entities, named has the entities
    that they may name. Without part_lines each page is one part, which a group then holds."""
    heading = F.format_string("<h3>%s: %s</h3>", escape(F.col("label")), escape(F.col("name")))
    of = lambda k, position, line: F.struct(F.lit(k).alias("section"), position.alias("position"), line.alias("line"))
    links = graph.with_places(sides, named, labels, hub_rows).select("page_id", F.inline(F.array(of(0, F.col("place"), escape(F.col("name"))), of(1, F.col("position"), heading))))
    sources = evidence.source_lines(facts, snippets, hub_rows).select("page_id", F.lit(2).alias("section"), F.col("number").alias("position"), "line")

    def texts(lines: DataFrame) -> DataFrame:
        """The lines' texts by section and part, made where the lines were numbered, so that only texts are shuffled."""
        part = F.floor((F.col("position") - 1) / part_lines) + 1 if part_lines else F.lit(1).cast("long")
        own = F.transform(F.array_sort(F.collect_set(F.struct("position", "line"))), lambda x: x["line"])  # a neighbour comes once
        return lines.withColumn("part", part).groupBy(F.col("page_id").alias("entity_id"), "part", "section").agg(F.when(F.col("section") == 0, F.array_join(own, " · ")).otherwise(F.array_join(own, "")).alias("text"))

    made = texts(links).unionByName(texts(sources))
    each = [F.first(F.when(F.col("section") == k, F.col("text")), ignorenulls=True).alias(f"text_{k}") for k in range(3)]
    found = materialise(made.groupBy("entity_id", "part").agg(*each), "page-parts")
    hubs = found.where("part > 1").groupBy("entity_id").agg(F.max("part").alias("parts"))
    found = entities.join(found, "entity_id", "left").join(hubs, "entity_id", "left").withColumns({"part": F.coalesce("part", F.lit(1)), "parts": F.coalesce("parts", F.lit(1))})

    def section(k: int, before: str, after: str) -> Column:
        return F.concat(F.lit(before), F.col(f"text_{k}"), F.lit(after))

    head = F.format_string('<h1 class="%s">%s</h1><p>%s</p>', colour(F.col("types"), red), escape(F.col("name")), F.array_join(F.array_sort("types"), ", "))
    place = F.when(F.col("parts") > 1, F.format_string("<p>part %d of %d</p>", "part", "parts"))
    empty = F.when(F.col("part") == 1, F.lit(f"<p>{NO_EDGES}</p>"))
    html = F.concat_ws("", head, place, section(0, "<nav>", "</nav>"), F.coalesce(section(1, "", ""), empty), section(2, "<ol>", "</ol>"))
    return found.select("entity_id", "part", "parts", part_name(F.col("entity_id"), F.col("part")).alias("file_name"), html.alias("html"))


def write_profiles(pages: DataFrame, path: str) -> None:
    """Writes pages as a table of files' names and contents, dealt out by name."""
    pages.repartitionByRange("file_name").write.mode("overwrite").option("compression", "zstd").parquet(path)
