"""Registered queries of the evidence graph over the given tables, each with its twin in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import amounts, times
from factloom.functions import text as tx
from factloom.operators import evidence, graph, intervals, pages, paths, quotes, resolve, sketches
from factloom.operators.components import components
from factloom.sinks.site import write_site
from factloom.sources import files
from factloom.sources import tables as tb
from factloom.staging import Dealt, by_slices, in_slice, materialise, shared_folder, shuffles_end, slices_of
from factloom.streaming import events as ev
from factloom.streaming import upkeep

#: The type whose entities are shown in red.
RED = "customer"
#: Predicates as they are counted side by side.
PREDICATE_CODES = ["IN_REGION", "LOCATED_IN", "ORDERED", "SUPPLIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Both ends of each edge, and named neighbours, for the SQL twins.
SIDES_SQL = """
side AS (SELECT subject_id AS page_id, 'out' AS direction, predicate, object_id AS other_id FROM edge
         UNION ALL SELECT object_id, 'in', predicate, subject_id FROM edge),
named AS (SELECT side.*, coalesce(entity.name, other_id) AS name, coalesce(label, predicate) AS label
          FROM side LEFT JOIN entity ON other_id = entity_id LEFT JOIN label ON predicate = code),
first_use AS (SELECT subject_id AS page_id, snippet_id, count(*) AS uses,
                min({'a': object_id, 'b': confidence, 'c': when_raw, 'd': order_key, 'e': line, 'f': amount_cents}) AS first FROM fact GROUP BY 1, 2),
note AS (SELECT page_id, snippet_id, uses, row_number() OVER (PARTITION BY page_id ORDER BY first, snippet_id) AS number FROM first_use)
"""


def written_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges, written once for queries that read them more than once."""
    return materialise(tb.edges(spark, sf_dir), "edges")


def written_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The edges and the facts that they come from, each written once: the order lines are scanned a single time."""
    facts = materialise(tb.facts(spark, sf_dir), "facts")
    return materialise(tb.edges(spark, sf_dir, facts), "edges"), facts


def of_pages(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], name: str, written: bool = False) -> DataFrame:
    """What build makes of the facts, page by page. Large tables are dealt into slices of pages; small ones are written if build reads them twice."""
    facts, slices = tb.facts(spark, sf_dir), slices_of(tb.fact_count(spark, sf_dir))
    if slices == 1:
        return build(materialise(facts, "facts") if written else facts)
    dealt = Dealt(facts, "subject_id", slices, "facts")
    return by_slices(spark, slices, lambda k: build(dealt.slice(k)), name, [dealt])


def query(sql: str, recursive: bool = False):
    """Registers a function under its name, with its SQL twin."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{tb.VIEWS_SQL}, {SIDES_SQL} {sql}"
        return f

    return register


@query("SELECT subject_id, predicate, object_id FROM edge")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.edges(spark, sf_dir)


@query("SELECT entity_id, name, predicate, object_id FROM entity JOIN edge ON entity_id = subject_id")
def edges_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_out(tb.entities(spark, sf_dir), tb.edges(spark, sf_dir)).select("entity_id", "name", "predicate", "object_id")


@query("SELECT entity_id, name, predicate, subject_id FROM entity JOIN edge ON entity_id = object_id")
def edges_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_in(tb.entities(spark, sf_dir), tb.edges(spark, sf_dir)).select("entity_id", "name", "predicate", "subject_id")


@query("SELECT page_id, direction, predicate, other_id FROM side")
def edges_both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.both_ends(tb.edges(spark, sf_dir))


@query("""SELECT subject_id, coalesce(s.name, subject_id) AS subject_name, CASE WHEN list_contains(s.types, 'customer') THEN 'red' ELSE 'green' END AS subject_colour,
       predicate, object_id, coalesce(o.name, object_id) AS object_name, CASE WHEN list_contains(o.types, 'customer') THEN 'red' ELSE 'green' END AS object_colour
FROM edge LEFT JOIN entity s ON subject_id = s.entity_id LEFT JOIN entity o ON object_id = o.entity_id""")
def edge_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_ends(tb.edges(spark, sf_dir), tb.entities(spark, sf_dir), RED)


@query("SELECT DISTINCT page_id, other_id FROM side")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(tb.edges(spark, sf_dir))


@query("""SELECT page_id, string_agg(name, ' · ' ORDER BY lower(name), other_id) AS bar, count(*) AS n
FROM (SELECT DISTINCT page_id, other_id, name FROM named) GROUP BY page_id""")
def neighbour_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, slices = tb.entities(spark, sf_dir), slices_of(2 * tb.fact_count(spark, sf_dir))
    if slices == 1:
        return graph.neighbour_bar(tb.edges(spark, sf_dir), entities)
    # an edge that is repeated makes the same pair again, so edges need not be distinct before pairs are
    edges = tb.places(spark, sf_dir).unionByName(tb.facts(spark, sf_dir).select("subject_id", "predicate", "object_id"))
    near = Dealt(graph.both_ends(edges).select("page_id", "other_id"), "page_id", slices, "neighbours")
    return by_slices(spark, slices, lambda k: graph.bar_of(near.slice(k).distinct(), entities), "bars", [near])


@query("SELECT subject_id, predicate, object_id, coalesce(label, predicate) AS label FROM edge LEFT JOIN label ON predicate = code")
def predicate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.labelled(tb.edges(spark, sf_dir), tb.predicate_labels(spark))


@query("""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY direction = 'in', lower(name), label, other_id)::INT AS position, direction, label, other_id, name
FROM named""")
def section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.sections(written_edges(spark, sf_dir), tb.entities(spark, sf_dir), tb.predicate_labels(spark))
    return found.withColumn("position", F.col("position").cast("int"))


@query("""SELECT subject_id, predicate, object_id, count(*) AS n_facts, sum(amount_cents)::BIGINT AS total_cents,
       string_agg(confidence || ' ' || when_raw || ' ' || order_key || ' ' || line, '; ' ORDER BY confidence, when_raw, order_key, line, amount_cents) AS facts
FROM fact GROUP BY subject_id, predicate, object_id""")
def edge_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.edge_facts(tb.facts(spark, sf_dir))
    shown = F.transform("facts", lambda x: F.concat_ws(" ", x["confidence"], x["when_raw"], x["order_key"], x["line"]))
    return found.withColumn("facts", F.array_join(shown, "; "))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def edgeless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a line."""
    orders = tb.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return graph.without_edge_of(orders, "o_orderkey", tb.table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""SELECT o_orderkey, CASE WHEN count(l_orderkey) = 0 THEN 'No links are recorded' ELSE count(l_orderkey) || ' links' END AS message
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def empty_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each order has, or the message of a page without edges."""
    counts = tb.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    found = tb.table(spark, sf_dir, "orders").select("o_orderkey").join(counts, "o_orderkey", "left")
    return found.select("o_orderkey", F.coalesce(F.concat(F.col("n").cast("string"), F.lit(" links")), F.lit(pages.NO_EDGES)).alias("message"))


@query("""SELECT page_id, coalesce(sum((predicate = 'IN_REGION')::INT), 0)::BIGINT AS "IN_REGION", sum((predicate = 'LOCATED_IN')::INT)::BIGINT AS "LOCATED_IN",
       sum((predicate = 'ORDERED')::INT)::BIGINT AS "ORDERED", sum((predicate = 'SUPPLIES')::INT)::BIGINT AS "SUPPLIES", count(*) AS degree FROM side GROUP BY page_id""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(tb.edges(spark, sf_dir), PREDICATE_CODES)


@query("""SELECT entity_id, array_to_string(list_sort(list_distinct(types)), ', ') AS types, CASE WHEN list_contains(types, 'customer') THEN 'red' ELSE 'green' END AS colour,
       CASE WHEN list_contains(types, 'club') THEN 'yes' END AS known FROM entity""")
def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.entities(spark, sf_dir)
    return rows.select("entity_id", F.array_join(F.array_sort(F.array_distinct("types")), ", ").alias("types"), tx.colour(F.col("types"), RED).alias("colour"), F.when(F.array_contains("types", "club"), "yes").alias("known"))


@query("SELECT type, count(*) AS entities FROM (SELECT unnest(types) AS type FROM entity) GROUP BY type")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.index_counts(tb.entities(spark, sf_dir))


@query("SELECT type, entity_id, name, 'entity-' || replace(entity_id, ':', '-') || '.html' AS file_name FROM (SELECT unnest(types) AS type, entity_id, name FROM entity)")
def index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of all profiles, by type and name."""
    return pages.index_list(tb.entities(spark, sf_dir))


@query("""SELECT subject_id, object_id, coalesce(label, code, 'linked') AS label FROM (SELECT subject_id, object_id, CASE WHEN predicate <> 'IN_REGION' THEN predicate END AS code FROM edge) e
LEFT JOIN label USING (code)""")
def default_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with their labels where places have no predicate at all."""
    edges = tb.edges(spark, sf_dir).withColumn("predicate", F.when(F.col("predicate") != "IN_REGION", F.col("predicate")))
    return graph.labelled(edges, tb.predicate_labels(spark)).select("subject_id", "object_id", "label")


@query("""SELECT subject_id, predicate, object_id FROM edge WHERE (subject_id, predicate, object_id) NOT IN (SELECT subject_id, predicate, object_id FROM fact WHERE confidence = 'exact')
AND predicate IN ('ORDERED', 'SUPPLIES')""")
def lost_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that are lost if only exact facts count."""
    facts = materialise(tb.facts(spark, sf_dir).select("subject_id", "predicate", "object_id", "confidence"), "facts")
    edges = facts.select("subject_id", "predicate", "object_id").distinct()
    return graph.lost_edges(edges, evidence.at_least(facts, "exact").select("subject_id", "predicate", "object_id").distinct())


#: Orders write their dates in eight ways and their prices in six; the twins say what must be read without parsing.
WHEN_SQL = """SELECT o_orderkey, CASE WHEN k = 7 THEN NULL WHEN k = 6 THEN NULL ELSE y END::INT AS first_year, CASE WHEN k IN (5, 7) THEN NULL WHEN k = 2 THEN y + 3 WHEN k = 6 THEN y ELSE y END::INT AS last_year,
       CASE k WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'range' WHEN 3 THEN 'about' WHEN 4 THEN 'year' WHEN 5 THEN 'bound' WHEN 6 THEN 'bound' END AS precision, k IN (5, 6) AS is_open
FROM (SELECT o_orderkey, o_orderkey % 8 AS k, year(o_orderdate) AS y FROM orders)"""


@query(WHEN_SQL)
def when_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in free text, read back as years with their precision."""
    date, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    year = F.date_format(date, "yyyy")
    ways = [F.date_format(date, "yyyy-MM-dd"), F.date_format(date, "yyyy-MM"), F.concat(year, F.lit(" - "), (F.year(date) + 3).cast("string")), F.concat(F.lit("~"), year), year, F.concat(F.lit("after "), year), F.concat(F.lit("before "), year)]
    raw = F.lit("not known")
    for n, way in enumerate(ways):
        raw = F.when(k == n, way).otherwise(raw)
    rows = tb.table(spark, sf_dir, "orders").select("o_orderkey", times.parse_when(raw).alias("read"))
    return rows.select("o_orderkey", *(F.col(f"read.{x}").alias(x) for x in ("first_year", "last_year", "precision", "is_open")))


#: Orders write their dates as people do, in two languages; the twin says from the dates alone which days are meant.
WORDED_SQL = """SELECT o_orderkey, array_to_string(list_transform(spans, lambda x: coalesce(x.a::DATE::VARCHAR, '') || '/' || coalesce(x.b::DATE::VARCHAR, '')), ' ') AS spans FROM (
SELECT o_orderkey, CASE o_orderkey % 14
  WHEN 0 THEN [{'a': y0, 'b': y1}] WHEN 1 THEN [{'a': m0, 'b': m1}] WHEN 2 THEN [{'a': y0, 'b': y1 + INTERVAL 2 YEAR}] WHEN 3 THEN [{'a': y0, 'b': NULL}]
  WHEN 4 THEN [{'a': y0, 'b': y1}, {'a': y0 + INTERVAL 3 YEAR, 'b': y1 + INTERVAL 4 YEAR}] WHEN 5 THEN [{'a': NULL, 'b': y1}] WHEN 6 THEN [{'a': d, 'b': d}]
  WHEN 7 THEN [{'a': y0 + INTERVAL 5 MONTH, 'b': y0 + INTERVAL 8 MONTH - INTERVAL 1 DAY}] WHEN 8 THEN [{'a': make_date(y // 10 * 10, 1, 1), 'b': make_date(y // 10 * 10 + 9, 12, 31)}]
  WHEN 9 THEN [{'a': y1 - INTERVAL (((y1::DATE - y0 + 1) // 3) - 1) DAY, 'b': y1}] WHEN 10 THEN [{'a': y0, 'b': y1 + INTERVAL 3 YEAR}] WHEN 11 THEN [{'a': y0, 'b': y1}] WHEN 12 THEN []::STRUCT(a TIMESTAMP, b TIMESTAMP)[] END AS spans
FROM (SELECT o_orderkey, y, d, make_date(y, 1, 1) AS y0, make_date(y, 12, 31)::TIMESTAMP AS y1, date_trunc('month', d) AS m0, date_trunc('month', d) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS m1 FROM (SELECT o_orderkey, year(o_orderdate) AS y, o_orderdate::DATE AS d FROM orders)))"""
RUSSIAN_MONTHS = "январе феврале марте апреле мае июне июле августе сентябре октябре ноябре декабре".split()
ENGLISH_MONTHS = "January February March April May June July August September October November December".split()


@query(WORDED_SQL)
def when_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as people write them, read as spans of days; overlapping ones are one."""
    date, k = F.col("o_orderdate"), F.col("o_orderkey") % 14
    year = lambda more=0: (F.year(date) + more).cast("string")
    said = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    month = F.element_at(F.array(*map(F.lit, RUSSIAN_MONTHS)), F.month(date))
    english = F.element_at(F.array(*map(F.lit, ENGLISH_MONTHS)), F.month(date))
    ways = [
        said(year(), " г."),
        said("в ", month, " ", year(), " года"),
        said("с ", year(), " по ", year(2)),
        said(year(), " - now"),
        said(year(3), "–", year(4), ", ", year()),
        said("до ", year(), " г."),
        said(F.dayofmonth(date).cast("string"), " ", english, " ", year()),
        said("summer of ", year()),
        said(F.substring(year(), 1, 3), "0s"),
        said("конец ", year(), " года"),
        said(year(), "-", year(2), " и ", year(1), "-", year(3)),
        said("~ ", year()),
        F.lit("не указано"),
        said("через год после ", year()),
    ]
    raw = F.lit(None).cast("string")
    for n, way in enumerate(ways):
        raw = F.when(k == n, way).otherwise(raw)
    shown = F.transform("spans", lambda x: F.concat(F.coalesce(x["first"].cast("string"), F.lit("")), F.lit("/"), F.coalesce(x["last"].cast("string"), F.lit(""))))
    return tb.table(spark, sf_dir, "orders").select("o_orderkey", times.when_spans(raw).alias("spans")).select("o_orderkey", F.array_join(shown, " ").alias("spans"))


AMOUNT_SQL = """SELECT o_orderkey, (CASE k WHEN 0 THEN n WHEN 1 THEN n + 0.5 WHEN 2 THEN (n + 0.5) * 1000 WHEN 3 THEN n * 1000000 WHEN 4 THEN n::DECIMAL(20,4) * 1000000000 END)::DOUBLE AS value,
       CASE k WHEN 0 THEN 'number' WHEN 1 THEN 'percent' WHEN 5 THEN NULL ELSE 'currency' END AS unit, CASE k WHEN 2 THEN 'USD' WHEN 3 THEN 'UAH' WHEN 4 THEN 'EUR' END AS currency
FROM (SELECT o_orderkey, o_orderkey % 6 AS k, (o_orderkey % 997)::DECIMAL(20,4) AS n FROM orders)"""


@query(AMOUNT_SQL)
def amount_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in free text, read back as a value with its unit and currency."""
    k, n = F.col("o_orderkey") % 6, (F.col("o_orderkey") % 997).cast("string")
    ways = [n, F.concat(n, F.lit(".5%")), F.concat(F.lit("$"), n, F.lit(",5 тыс.")), F.concat(n, F.lit(" млн гривен")), F.concat(F.lit("€"), n, F.lit(" млрд"))]
    raw = F.lit("some of it")
    for at, way in enumerate(ways):
        raw = F.when(k == at, way).otherwise(raw)
    rows = tb.table(spark, sf_dir, "orders").select("o_orderkey", amounts.parse_amount(raw).alias("read"))
    return rows.select("o_orderkey", F.col("read.value").cast("double").alias("value"), "read.unit", "read.currency")


@query("""SELECT subject_id, object_id, order_key, line, amount_cents, concat_ws(' · ', when_raw,
       CASE WHEN amount_cents >= 1000000 THEN '$' || (amount_cents // 100) END, CASE WHEN confidence <> 'exact' THEN confidence END) AS shown FROM fact""")
def fact_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.with_qualifiers(tb.facts(spark, sf_dir)).select("subject_id", "object_id", "order_key", "line", "amount_cents", "shown")


@query("SELECT subject_id, predicate, object_id, order_key, line, confidence FROM fact WHERE confidence = 'exact'")
def exact_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.at_least(tb.facts(spark, sf_dir), "exact").select("subject_id", "predicate", "object_id", "order_key", "line", "confidence")


@query("SELECT page_id, snippet_id, number::INT AS number, uses FROM note")
def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.footnotes(tb.facts(spark, sf_dir)).withColumn("number", F.col("number").cast("int"))


@query("""SELECT fact.subject_id, object_id, order_key, line, amount_cents, fact.snippet_id, number::INT AS number,
       'fnref-' || number || '-' || row_number() OVER (PARTITION BY fact.subject_id, fact.snippet_id ORDER BY object_id, confidence, when_raw, order_key, line, amount_cents) AS back_link
FROM fact JOIN note ON subject_id = page_id AND fact.snippet_id = note.snippet_id""")
def facts_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    def numbered(facts: DataFrame) -> DataFrame:
        return evidence.numbered(facts).select("subject_id", "object_id", "order_key", "line", "amount_cents", "snippet_id", F.col("number").cast("int").alias("number"), "back_link")

    return of_pages(spark, sf_dir, numbered, "numbered", written=True)


@query("SELECT DISTINCT subject_id AS page_id, snippet_id FROM fact")
def page_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snippets of each page, each once."""
    return tb.facts(spark, sf_dir).select(F.col("subject_id").alias("page_id"), "snippet_id").dropDuplicates(["page_id", "snippet_id"])


@query("SELECT subject_id, object_id, order_key, line, fact.snippet_id, source_url FROM fact LEFT JOIN snippet ON fact.snippet_id = snippet.snippet_id")
def fact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.cited(tb.facts(spark, sf_dir), tb.snippets(spark, sf_dir))
    return found.select("subject_id", "object_id", "order_key", "line", "snippet_id", "source_url")


@query("""SELECT page_id, string_agg('<li id="fn-' || number || '">' || coalesce(source_url, '') || '</li>', '' ORDER BY number) AS sources, count(*) AS n_sources
FROM note LEFT JOIN snippet ON note.snippet_id = snippet.snippet_id GROUP BY page_id""")
def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    snippets = tb.snippets(spark, sf_dir)
    return of_pages(spark, sf_dir, lambda facts: evidence.source_list(facts, snippets), "sources")


@query("SELECT subject_id AS page_id, max(when_raw) AS updated FROM fact GROUP BY subject_id")
def last_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.last_change(tb.facts(spark, sf_dir))


#: Quotations come from places all over the texts; a third of them are damaged by a word that no text has.
PLACE_SQL = "(coalesce(abs(doc_id), 0) * 7919) % greatest(length(coalesce(text, '')) - 100, 1)"
QUOTES_SQL = f"""SELECT doc_id AS quote_id, doc_id AS snippet_id, substr(coalesce(text, ''), ({PLACE_SQL} + 1)::BIGINT, 40) || CASE WHEN coalesce(doc_id, 0) % 3 = 0 THEN ' zzqx ' ELSE '... ' END || substr(coalesce(text, ''), ({PLACE_SQL} + 61)::BIGINT, 40) AS quote FROM documents"""


@query(f"""SELECT quote_id, q.snippet_id, coalesce(len(list_filter(list_filter(list_transform(string_split(quote, '...'), lambda p: trim(regexp_replace(lower(p), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), lambda p: length(p) > 0),
       lambda p: NOT contains(trim(regexp_replace(lower(d.text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), p))) = 0, false) AS found
FROM ({QUOTES_SQL}) q LEFT JOIN documents d ON q.snippet_id = d.doc_id""")
def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slices of each document, from anywhere in it, as a quotation with an elision; every third one is damaged."""
    docs = tb.table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    own = F.coalesce(F.abs("doc_id"), F.lit(0))
    at = ((own * 7919) % F.greatest(F.char_length(text) - 100, F.lit(1))).cast("int")
    quote = F.concat(F.substr(text, at + 1, F.lit(40)), F.when(F.coalesce("doc_id", F.lit(0)) % 3 == 0, " zzqx ").otherwise("... "), F.substr(text, at + 61, F.lit(40)))
    quotes = docs.select(F.col("doc_id").alias("quote_id"), F.col("doc_id").alias("snippet_id"), quote.alias("quote"))
    return evidence.quote_check(quotes, docs.select(F.col("doc_id").alias("snippet_id"), "text"))


CLEAN_SQL = r"""cleaned AS (SELECT page_id, url, regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') AS html FROM pages)"""


@query(f""", {CLEAN_SQL} SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, trim(regexp_extract(html, '<html[^>]*\\slang="([^"]*)"', 1)) AS lang,
       trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, trim(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)) AS heading FROM cleaned""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.titles(tb.table(spark, sf_dir, "pages"))


@query(f""", {CLEAN_SQL}, anchors AS (SELECT page_id, regexp_extract_all(html, '(?s)<a\\s+href="[^"]*"\\s*>.*?</a>') AS a FROM cleaned),
flat AS (SELECT page_id, unnest(range(len(a))) AS position, unnest(a) AS anchor FROM anchors)
SELECT page_id, position::BIGINT AS position, regexp_extract(anchor, 'href="([^"]*)"', 1) AS target, trim(regexp_extract(anchor, '(?s)>(.*?)</a>', 1)) AS shown FROM flat""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(tb.table(spark, sf_dir, "pages"))


@query(f""", {CLEAN_SQL} SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '[\\t\\n\\r ]+', ' ', 'g'))) AS n_chars,
       md5(trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '[\\t\\n\\r ]+', ' ', 'g'))) AS digest FROM cleaned""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.plain_text(tb.table(spark, sf_dir, "pages")).select("page_id", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


#: Entities without those that the index leaves out, so that some links dangle.
LISTED_SQL = "listed AS (SELECT * FROM entity WHERE kind <> 'nation' OR nation_key IS NOT NULL OR entity_id < 'nation:2')"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.entities(spark, sf_dir).where((F.col("kind") != "nation") | F.col("nation_key").isNotNull() | (F.col("entity_id") < "nation:2"))


@query(f", {LISTED_SQL} SELECT other_id AS entity_id, count(*) AS links FROM side WHERE other_id NOT IN (SELECT entity_id FROM listed) GROUP BY other_id")
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dangling(tb.edges(spark, sf_dir), _listed(spark, sf_dir))


@query(f", {LISTED_SQL} SELECT subject_id, predicate, object_id FROM edge WHERE subject_id IN (SELECT entity_id FROM listed) AND object_id IN (SELECT entity_id FROM listed)")
def live_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.live(tb.edges(spark, sf_dir), _listed(spark, sf_dir)).select("subject_id", "predicate", "object_id")


@query(""", alias AS (SELECT upper(trim(regexp_replace(trim(name), '[^\\p{L}\\p{N}]+', '_', 'g'), '_')) AS key, min(entity_id) AS entity_id FROM entity WHERE kind IN ('nation', 'region', 'customer') GROUP BY 1),
mention AS (SELECT c_custkey AS mention_id, CASE c_custkey % 3 WHEN 0 THEN lower(c_name) WHEN 1 THEN '  ' || replace(c_name, '#', ' - ') ELSE c_name || ' Ltd' END AS surface FROM customer)
SELECT mention_id, surface, entity_id FROM mention LEFT JOIN alias ON upper(trim(regexp_replace(trim(surface), '[^\\p{L}\\p{N}]+', '_', 'g'), '_')) = key""")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written in three ways, one of which stands for nothing."""
    aliases = tb.entities(spark, sf_dir).where(F.col("kind").isin("nation", "region", "customer")).select(F.col("name").alias("surface"), "entity_id")
    k, name = F.col("c_custkey"), F.col("c_name")
    surface = F.when(k % 3 == 0, F.lower(name)).when(k % 3 == 1, F.concat(F.lit("  "), F.replace(name, F.lit("#"), F.lit(" - ")))).otherwise(F.concat(name, F.lit(" Ltd")))
    mentions = tb.table(spark, sf_dir, "customer").select(k.alias("mention_id"), surface.alias("surface"))
    return resolve.resolve(mentions, aliases)


@query("""SELECT entity_id, string_agg(DISTINCT surface, ', ' ORDER BY surface) AS aliases FROM (
SELECT 'nation:' || n_nationkey AS entity_id, upper(n_name) AS surface FROM nation UNION ALL SELECT 'nation:' || n_nationkey, lower(n_name) FROM nation) GROUP BY entity_id""")
def entity_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = tb.table(spark, sf_dir, "nation").select(tb.ref("nation", "n_nationkey").alias("entity_id"), F.explode(F.array(F.upper("n_name"), F.lower("n_name"))).alias("surface"))
    return resolve.aliases_of(nations)


ESCAPED_SQL = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')"


@query(f"SELECT page_id, md5({ESCAPED_SQL.format('html')}) AS digest, length({ESCAPED_SQL.format('html')}) AS n_chars FROM pages")
def escaped_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = tb.table(spark, sf_dir, "pages").select("page_id", tx.escape(F.col("html")).alias("html"))
    return escaped.select("page_id", F.md5("html").alias("digest"), F.char_length("html").cast("long").alias("n_chars"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, 'entity-' || user_id || '.html' AS file_name, 'https://upload-' || substr(sha256(props), 1, 6) AS upload FROM events""")
def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times to the minute, file names from ids and short digests of uploads."""
    rows = tb.table(spark, sf_dir, "events")
    return rows.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), F.format_string("entity-%d.html", "user_id").alias("file_name"), F.concat(F.lit("https://upload-"), F.substring(F.sha2("props", 256), 1, 6)).alias("upload"))


PROFILE_SQL = f"""
SELECT e.entity_id, 'entity-' || replace(e.entity_id, ':', '-') || '.html' AS file_name,
  '<h1 class="' || CASE WHEN list_contains(types, 'customer') THEN 'red' ELSE 'green' END || '">' || {ESCAPED_SQL.format("e.name")} || '</h1><p>' || array_to_string(list_sort(types), ', ') || '</p>'
  || coalesce('<nav>' || {ESCAPED_SQL.format("bar")} || '</nav>', '') || coalesce(body, '<p>No links are recorded</p>') || coalesce('<ol>' || sources || '</ol>', '') AS html
FROM entity e
LEFT JOIN (SELECT page_id, string_agg(name, ' · ' ORDER BY lower(name), other_id) AS bar FROM (SELECT DISTINCT page_id, other_id, name FROM named) GROUP BY page_id) b ON b.page_id = e.entity_id
LEFT JOIN (SELECT page_id, string_agg('<h3>' || {ESCAPED_SQL.format("label")} || ': ' || {ESCAPED_SQL.format("name")} || '</h3>', '' ORDER BY direction = 'in', lower(name), label, other_id) AS body FROM named GROUP BY page_id) h ON h.page_id = e.entity_id
LEFT JOIN (SELECT page_id, string_agg('<li id="fn-' || number || '">' || {ESCAPED_SQL.format("coalesce(source_url, '')")} || '</li>', '' ORDER BY number) AS sources FROM note LEFT JOIN snippet ON note.snippet_id = snippet.snippet_id GROUP BY page_id) s ON s.page_id = e.entity_id"""


def all_profiles(spark: SparkSession, sf_dir: str, part_lines: int | None) -> DataFrame:
    """Every entity's page, whole or in parts. Large tables are dealt into slices of pages: what facts say of their subject is in
    the subject's slice, what they say of their object is dealt to the object's."""
    entities, snippets, labels, slices = tb.entities(spark, sf_dir), tb.snippets(spark, sf_dir), tb.predicate_labels(spark), slices_of(3 * tb.fact_count(spark, sf_dir))
    if slices == 1:
        edges, facts = written_graph(spark, sf_dir)
        return pages.profiles_of(entities, entities, graph.both_ends(edges), facts, snippets, labels, RED, part_lines)
    facts = Dealt(tb.facts(spark, sf_dir), "subject_id", slices, "facts")
    objects = Dealt(facts.all().select(F.col("object_id").alias("page_id"), "predicate", F.col("subject_id").alias("other_id")), "page_id", slices, "objects")
    places = graph.both_ends(tb.places(spark, sf_dir))

    def of_slice(k: int) -> DataFrame:
        own = facts.slice(k)
        out = own.select(F.col("subject_id").alias("page_id"), F.lit("out").alias("direction"), "predicate", F.col("object_id").alias("other_id"))
        back = objects.slice(k).select("page_id", F.lit("in").alias("direction"), "predicate", "other_id")
        sides = out.unionByName(back).distinct().unionByName(in_slice(places, "page_id", slices, k))
        return pages.profiles_of(in_slice(entities, "entity_id", slices, k), entities, materialise(sides, "sides"), own, snippets, labels, RED, part_lines)

    return by_slices(spark, slices, of_slice, "profiles", [facts, objects])


@query(PROFILE_SQL)
def profile_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_profiles(spark, sf_dir, None).select("entity_id", "file_name", "html")


@query(""", near AS (SELECT DISTINCT page_id, other_id FROM side), first AS (SELECT page_id AS start_id, other_id FROM near WHERE page_id LIKE 'region:%'),
hop AS (SELECT start_id, near.other_id AS far_id, count(*) AS ways FROM first JOIN near ON first.other_id = near.page_id WHERE near.other_id <> start_id GROUP BY 1, 2)
SELECT start_id, far_id, ways FROM hop WHERE (start_id, far_id) NOT IN (SELECT start_id, other_id FROM first)""")
def two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies two links from each region."""
    start = tb.entities(spark, sf_dir).where("kind = 'region'")
    return graph.two_hops(written_edges(spark, sf_dir), start)


@query("SELECT other_id FROM side WHERE page_id = 'supplier:1' INTERSECT SELECT other_id FROM side WHERE page_id = 'supplier:2'")
def common_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.common_neighbours(tb.edges(spark, sf_dir), "supplier:1", "supplier:2")


#: Lines of a section on one part of a page, where pages are shown in parts.
SHORT_PART = 25
PARTS_SQL = f"""
, bar AS (SELECT page_id, {ESCAPED_SQL.format("name")} AS line, row_number() OVER (PARTITION BY page_id ORDER BY lower(name), other_id) AS position FROM (SELECT DISTINCT page_id, other_id, name FROM named)),
body AS (SELECT page_id, '<h3>' || {ESCAPED_SQL.format("label")} || ': ' || {ESCAPED_SQL.format("name")} || '</h3>' AS line, row_number() OVER (PARTITION BY page_id ORDER BY direction = 'in', lower(name), label, other_id) AS position FROM named),
source AS (SELECT page_id, '<li id="fn-' || number || '">' || {ESCAPED_SQL.format("coalesce(source_url, '')")} || '</li>' AS line, number AS position FROM note LEFT JOIN snippet ON note.snippet_id = snippet.snippet_id),
lines AS (SELECT *, (position - 1) // {SHORT_PART} + 1 AS part FROM (SELECT 0 AS section, * FROM bar UNION ALL SELECT 1, * FROM body UNION ALL SELECT 2, * FROM source)),
piece AS (SELECT page_id, part, '<nav>' || string_agg(line, ' · ' ORDER BY position) FILTER (section = 0) || '</nav>' AS bar, string_agg(line, '' ORDER BY position) FILTER (section = 1) AS body,
       '<ol>' || string_agg(line, '' ORDER BY position) FILTER (section = 2) || '</ol>' AS sources, max(part) OVER (PARTITION BY page_id) AS parts FROM lines GROUP BY page_id, part)
SELECT entity_id, coalesce(part, 1)::BIGINT AS part, coalesce(parts, 1)::BIGINT AS parts, 'entity-' || replace(entity_id, ':', '-') || CASE WHEN part > 1 THEN '-' || part ELSE '' END || '.html' AS file_name,
  '<h1 class="' || CASE WHEN list_contains(types, 'customer') THEN 'red' ELSE 'green' END || '">' || {ESCAPED_SQL.format("name")} || '</h1><p>' || array_to_string(list_sort(types), ', ') || '</p>'
  || CASE WHEN parts > 1 THEN '<p>part ' || part || ' of ' || parts || '</p>' ELSE '' END || coalesce(bar, '') || coalesce(body, CASE WHEN coalesce(part, 1) = 1 THEN '<p>No links are recorded</p>' END, '') || coalesce(sources, '') AS html
FROM entity LEFT JOIN piece ON page_id = entity_id"""


@query(PARTS_SQL)
def profile_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page in numbered parts of a few lines, as a hub's page is shown."""
    return all_profiles(spark, sf_dir, SHORT_PART)


#: Customers that stand for others: chains of up to three, circles of two, ids of another kind, and some with two meanings.
SAME_SQL = """same AS (
  SELECT 'customer:' || c_custkey AS entity_id, 'customer:' || (c_custkey - 1) AS stands_for FROM customer WHERE c_custkey % 10 IN (1, 2, 3)
  UNION ALL SELECT 'customer:' || c_custkey, 'customer:' || (c_custkey + CASE WHEN c_custkey % 100 = 58 THEN 1 ELSE -1 END) FROM customer WHERE c_custkey % 100 IN (58, 59)
  UNION ALL SELECT 'customer:' || c_custkey, 'supplier:' || c_custkey FROM customer WHERE c_custkey % 20 = 7
  UNION ALL SELECT 'customer:' || c_custkey, 'part:' || c_custkey FROM customer WHERE c_custkey % 10 = 3),
target AS (SELECT entity_id, min(stands_for) AS stands_for FROM same GROUP BY entity_id),
walk AS (SELECT entity_id, stands_for AS spot, 1 AS steps FROM target UNION ALL SELECT walk.entity_id, target.stands_for, steps + 1 FROM walk JOIN target ON spot = target.entity_id WHERE steps < 20),
root AS (SELECT entity_id, coalesce(min(spot) FILTER (spot NOT IN (SELECT entity_id FROM target)), min(spot)) AS root FROM walk GROUP BY entity_id),
moved AS (SELECT * FROM root WHERE entity_id <> root)"""


def _same(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    meanings = F.array(
        F.when((k % 10).isin(1, 2, 3), tb.ref("customer", k - 1)),
        F.when(k % 100 == 58, tb.ref("customer", k + 1)).when(k % 100 == 59, tb.ref("customer", k - 1)),
        F.when(k % 20 == 7, tb.ref("supplier", k)),
        F.when(k % 10 == 3, tb.ref("part", k)),
    )
    rows = tb.table(spark, sf_dir, "customer").select(tb.ref("customer", k).alias("entity_id"), F.explode(meanings).alias("stands_for"))
    return rows.where("stands_for IS NOT NULL")


@query(f", {SAME_SQL} SELECT entity_id, root FROM moved", recursive=True)
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each id finally stands for."""
    return resolve.canonical_ids(_same(spark, sf_dir))


CANONICAL_SQL = f""", {SAME_SQL}, said AS (SELECT coalesce(s.root, subject_id) AS subject, predicate, coalesce(o.root, object_id) AS object, {{0}} FROM {{1}} LEFT JOIN moved s ON subject_id = s.entity_id LEFT JOIN moved o ON object_id = o.entity_id)"""


@query(f"{CANONICAL_SQL.format('1 AS one', 'edge')} SELECT subject AS subject_id, predicate, object AS object_id, count(*) AS merged FROM said WHERE subject <> object GROUP BY ALL", recursive=True)
def canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One heading for each canonical triple, and how many headings it was before names were resolved."""
    roots = materialise(resolve.canonical_ids(_same(spark, sf_dir)), "roots")
    return resolve.canonical_edges(tb.edges(spark, sf_dir), roots)


@query(f"""{CANONICAL_SQL.format('confidence, when_raw, order_key, line, amount_cents', 'fact')} SELECT subject AS subject_id, predicate, object AS object_id, count(*) AS n_facts, sum(amount_cents)::BIGINT AS total_cents,
       string_agg(confidence || ' ' || when_raw || ' ' || order_key || ' ' || line, '; ' ORDER BY confidence, when_raw, order_key, line, amount_cents) AS facts FROM said WHERE subject <> object GROUP BY ALL""", recursive=True)
def canonical_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts under each canonical heading."""
    roots = materialise(resolve.canonical_ids(_same(spark, sf_dir)), "roots")
    found = evidence.edge_facts(resolve.canonical_facts(tb.facts(spark, sf_dir), roots))
    shown = F.transform("facts", lambda x: F.concat_ws(" ", x["confidence"], x["when_raw"], x["order_key"], x["line"]))
    return found.withColumn("facts", F.array_join(shown, "; "))


#: Levels that the twin of the search has; no page of the tables is as far from the start, and the last level is empty.
LEVELS = 9
START = "customer:1"


def _levels_sql() -> str:
    level = ", l{k} AS MATERIALIZED (SELECT other_id AS node, min(list_append(path, other_id)) AS path FROM l{j} JOIN near ON node = page_id WHERE other_id NOT IN ({known}) GROUP BY other_id)"
    known = lambda k: " UNION ALL ".join(f"SELECT node FROM l{j}" for j in range(k))
    steps = "".join(level.format(k=k, j=k - 1, known=known(k)) for k in range(1, LEVELS))
    rows = " UNION ALL ".join(f"SELECT node, path, {k} AS distance FROM l{k}" for k in range(LEVELS))
    return f""", near AS MATERIALIZED (SELECT DISTINCT page_id, other_id FROM side), l0 AS (SELECT '{START}' AS node, ['{START}'] AS path){steps}
SELECT node, distance, CASE WHEN distance > 0 THEN path[-2] END AS parent, array_to_string(path, ' > ') AS path FROM ({rows})"""


@query(_levels_sql())
def least_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each page is from one customer's, and the least of the shortest ways there."""
    start = tb.entities(spark, sf_dir).where(F.col("entity_id") == START)
    return paths.least_paths(written_edges(spark, sf_dir), start).withColumn("path", F.array_join("path", " > "))


@query("""SELECT entity_id, min(entity_id) OVER (PARTITION BY region) AS component, count(*) OVER (PARTITION BY region) AS size FROM (
  SELECT 'customer:' || c_custkey AS entity_id, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'nation:' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_regionkey FROM region)""")
def place_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is connected by places alone: the component of each page, named by its smallest id, and its size."""
    places = tb.edges(spark, sf_dir).where(F.col("predicate").isin("LOCATED_IN", "IN_REGION")).select("subject_id", "object_id")
    found = materialise(components(places), "components")
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    return found.join(sizes, "root").select(F.col("node").alias("entity_id"), F.col("root").alias("component"), "size")


@query(""", shipped AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey),
span AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS first, coalesce(shipped, o_orderdate)::DATE AS last FROM orders LEFT JOIN shipped ON l_orderkey = o_orderkey)
SELECT a.o_custkey, a.o_orderkey AS one, b.o_orderkey AS other, greatest(a.first, b.first)::VARCHAR AS first, least(a.last, b.last)::VARCHAR AS last FROM span a JOIN span b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
WHERE a.first <= a.last AND b.first <= b.last AND a.first <= b.last AND b.first <= a.last""")
def overlapping_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer that were open on the same day: from the order to its last line's shipment."""
    shipped = tb.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    spans = tb.table(spark, sf_dir, "orders").join(shipped, "o_orderkey", "left")
    spans = materialise(spans.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("first"), F.coalesce("shipped", "o_orderdate").cast("date").alias("last")), "spans")
    pairs = intervals.overlaps(spans, spans, ["o_custkey"], width_days=360).where("left_o_orderkey < right_o_orderkey")
    shared = [F.greatest("left_first", "right_first").cast("string").alias("first"), F.least("left_last", "right_last").cast("string").alias("last")]
    return pairs.select("o_custkey", F.col("left_o_orderkey").alias("one"), F.col("right_o_orderkey").alias("other"), *shared)


@query("""SELECT e.event_id, e.user_id, (SELECT max({'ts': v.ts, 'event_id': v.event_id}).event_id FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.ts <= e.ts) AS view_id FROM events e WHERE e.event_type = 'purchase'""")
def last_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase what its user had viewed last."""
    events = tb.table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return intervals.last_before(bought, viewed, ["user_id"], "ts", ["view_id"], cell_days=7).select("event_id", "user_id", "view_id")


#: Words of a quotation, and the word by which one of them is replaced or before which one is put.
QUOTE_WORDS, WRONG_WORD = 14, "zzqx"


def quote_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where fourteen words of each document stand in it, a third of them quoted with a wrong word and a third with a word too many.

    No SQL can tell the nearest place; tests hold it against all places.
    """
    docs = tb.table(spark, sf_dir, "documents")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    at = F.pmod(F.coalesce(F.abs("doc_id"), F.lit(0)) * 7919, F.greatest(F.size("words") - QUOTE_WORDS, F.lit(1))).cast("int")
    rows = docs.select("doc_id", words.alias("words")).select("doc_id", F.slice("words", at + 1, F.lit(QUOTE_WORDS)).alias("said"))
    middle = F.when(F.col("doc_id") % 3 == 1, F.array(F.lit(WRONG_WORD))).when(F.col("doc_id") % 3 == 2, F.concat(F.array(F.lit(WRONG_WORD)), F.slice("said", 8, 1))).otherwise(F.slice("said", 8, 1))
    quote = F.array_join(F.concat(F.slice("said", 1, 7), middle, F.slice("said", 9, QUOTE_WORDS)), " ")
    cited = rows.select(F.col("doc_id").alias("quote_id"), F.col("doc_id").alias("snippet_id"), quote.alias("quote"))
    return quotes.quote_places(cited, docs.select(F.col("doc_id").alias("snippet_id"), "text"))


QUERIES["quote_places"] = quote_places


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile of one customer: header, neighbours, headings with their facts, numbered sources."""
    one = F.col("subject_id") == "customer:1"
    entities, labels = tb.entities(spark, sf_dir), tb.predicate_labels(spark)
    edges = tb.edges(spark, sf_dir).where(one | (F.col("object_id") == "customer:1"))
    facts = tb.facts(spark, sf_dir).where(one)
    page = pages.profiles(entities.where("entity_id = 'customer:1'"), edges, facts, tb.snippets(spark, sf_dir), labels, RED)
    headings = graph.sections(edges, entities, labels).where("page_id = 'customer:1'")
    shown = evidence.edge_facts(facts).select(F.col("object_id").alias("other_id"), "n_facts", "total_cents", F.array_join(F.transform("facts", lambda x: F.concat_ws(" ", x["when_raw"], x["confidence"])), "; ").alias("facts"))
    return headings.join(shown, "other_id", "left").join(page.select("entity_id", F.char_length("html").alias("page_chars")), headings["page_id"] == page["entity_id"]).select("page_id", "position", "direction", "label", "other_id", "name", "n_facts", "total_cents", "facts", "page_chars").orderBy("position")


@query("""SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total_cents FROM events GROUP BY 1, 2""")
def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.daily(tb.table(spark, sf_dir, "events"))


@query(""", gap AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM gap)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sessions(tb.table(spark, sf_dir, "events"))


@query("""SELECT page_id, count(*) AS facts, count(DISTINCT other_id) AS neighbours, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated FROM (
SELECT 'user:' || user_id AS page_id, 'type:' || event_type AS other_id, ts FROM events UNION ALL SELECT 'type:' || event_type, 'user:' || user_id, ts FROM events) GROUP BY page_id""")
def upkept_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a stream of events has kept up to date, batch by batch; the twin builds them all at once."""
    path = f"{sf_dir}/events.parquet"
    stream = ev.read_stream(spark, path, spark.read.parquet(path).schema)
    facts = stream.select(F.col("event_id").alias("fact_id"), "ts", tb.ref("user", "user_id").alias("subject_id"), F.lit("DID").alias("predicate"), tb.ref("type", "event_type").alias("object_id"))
    folder = shared_folder(spark, "upkeep")
    made = upkeep.PageUpkeep(spark, f"{folder}/pages", "36500 days").run(facts, f"{folder}/checkpoint")
    return made.withColumn("updated", F.date_format("updated", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT substr(sha256(coalesce(html, '')), 1, 6) AS upload_id, 'page-' || page_id || '.html' AS file_name, length(coalesce(html, ''))::BIGINT AS n_chars FROM pages")
def upload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages written as files of their own and taken in as uploads, each with an id of its text."""
    folder = shared_folder(spark, "uploads")
    raw = tb.table(spark, sf_dir, "pages")
    write_site(raw.select(F.format_string("page-%d.html", "page_id").alias("file_name"), "html"), folder)
    return files.uploads(spark, f"{folder}/*.html").select("upload_id", "file_name", F.char_length("text").cast("long").alias("n_chars"))


@query("SELECT subject_id, predicate, object_id, order_key, line, when_raw, amount_cents, confidence, snippet_id FROM fact")
def facts_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written as lines of JSON, as an extractor leaves them, and read by an explicit schema."""
    found = tb.facts(spark, sf_dir)
    folder = shared_folder(spark, "fact-files")
    with shuffles_end(spark):
        found.write.option("compression", "gzip").json(folder)
    return files.fact_files(spark, folder, found.schema)


#: Errors within which the estimates of sketches are held: of a distinct count, and of a median's rank.
COUNT_ERROR, RANK_ERROR = 0.05, 0.03


@query("""SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::INT AS level, count(*) AS n, true AS parts_close, true AS median_close FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def sketch_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube of order lines merged from sketches by day, and whether its estimates keep to their errors when held against the lines."""
    by = ["l_returnflag", "l_linestatus"]
    lines = tb.table(spark, sf_dir, "lineitem").select(*by, F.to_date("l_shipdate").alias("day"), "l_partkey", "l_extendedprice")
    kept = materialise(sketches.stored(lines, ["day", *by], "l_partkey", "l_extendedprice"), "sketches")
    found = sketches.cubed(kept, by).select(*by, F.col("level").cast("int").alias("level"), "n", sketches.distinct_count().alias("parts"), sketches.quantile(0.5).alias("median"))
    found = materialise(found, "cube")
    # each line is in four groups, by whose medians it counts below or above
    in_groups = [F.struct(F.lit(level).alias("level"), *(F.when(F.lit(not level & (2 >> k)), F.col(c)).alias(c) for k, c in enumerate(by))) for level in range(4)]
    each = lines.select("l_partkey", "l_extendedprice", F.inline(F.array(*in_groups)))
    group = ["level", *by]
    told = found.select(*(F.col(c).alias(f"_{c}") for c in group), "median")
    each = each.join(told, [each[c].eqNullSafe(told[f"_{c}"]) for c in group])
    share = lambda x: F.avg(x.cast("double"))
    true = each.groupBy(*group).agg(F.count_distinct("l_partkey").alias("true_parts"), share(F.col("l_extendedprice") < F.col("median")).alias("below"), share(F.col("l_extendedprice") <= F.col("median")).alias("upto"))
    true = true.select(*(F.col(c).alias(f"_{c}") for c in group), "true_parts", "below", "upto")
    held = found.join(true, [found[c].eqNullSafe(true[f"_{c}"]) for c in group])
    close = F.abs(F.col("parts") - F.col("true_parts")) <= F.greatest(F.lit(1), COUNT_ERROR * F.col("true_parts"))
    middle = (F.col("below") <= 0.5 + RANK_ERROR) & (F.col("upto") >= 0.5 - RANK_ERROR)
    return held.select(*(F.col(c) for c in by), "level", "n", close.alias("parts_close"), middle.alias("median_close"))
