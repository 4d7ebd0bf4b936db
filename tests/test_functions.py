import pytest
from pyspark.sql import functions as F

from factloom.functions import amounts, times
from factloom.functions import text as tx
from factloom.operators import evidence, graph, pages, resolve


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "first", "last", "precision", "is_open"),
    [
        (None, None, None, None, None),
        ("2009", 2009, 2009, "year", False),
        ("2014-2016", 2014, 2016, "range", False),
        ("2024-05", 2024, 2024, "month", False),
        ("2024-05-17", 2024, 2024, "day", False),
        ("~2018", 2018, 2018, "about", False),
        ("after 2010", 2010, None, "bound", True),
        ("before 2010", None, 2010, "bound", True),
        ("2001-2003, 2010", 2001, 2010, "ranges", False),
        ("2014-13", None, None, None, False),
        ("с 2010 по 2012", 2010, 2012, "range", False),
        ("2025 г.", 2025, 2025, "year", False),
        ("now", None, None, "now", True),
        ("some time ago", None, None, None, False),
    ],
)
def test_parse_when(spark, raw, first, last, precision, is_open):
    found = one(spark, times.parse_when(F.col("w")), w=raw)
    assert (found.raw, found.first_year, found.last_year, found.precision, found.is_open) == (raw, first, last, precision, is_open)


@pytest.mark.parametrize(
    ("raw", "value", "unit", "currency"),
    [
        (None, None, None, None),
        ("7.5%", 7.5, "percent", None),
        ("120000", 120000, "number", None),
        ("$3 млн", 3_000_000, "currency", "USD"),
        ("$12,5 тыс.", 12_500, "currency", "USD"),
        ("40 млн гривен", 40_000_000, "currency", "UAH"),
        ("unknown", None, None, None),
        ("1,500,000 $", 1_500_000, "currency", "USD"),
        ("1 500 000 гривен", 1_500_000, "currency", "UAH"),
        ("1\u00a0500\u00a0000,5 руб.", 1_500_000.5, "currency", "RUB"),
        ("1.500.000,25 евро", 1_500_000.25, "currency", "EUR"),
        ("$1,500", 1500, "currency", "USD"),
        ("1,500", None, None, None),
        ("1.500 руб", None, None, None),
        ("1,234.5", 1234.5, "number", None),
        ("70-80%", None, None, None),
        ("$1.5 million", 1_500_000, "currency", "USD"),
        ("10 миллионов", 10_000_000, "number", None),
        ("2 из 3", None, None, None),
        ("1 50 000", None, None, None),
        ("", None, None, None),
    ],
)
def test_parse_amount(spark, raw, value, unit, currency):
    found = one(spark, amounts.parse_amount(F.col("a")), a=raw)
    assert (None if found.value is None else float(found.value), found.unit, found.currency) == (value, unit, currency)


#: Invented examples of the shapes that times are written in, with the spans meant; None: not read, as it says nothing sure.
WHEN_SHAPES = [
    ("2015 год", "2015-01-01/2015-12-31 year"),
    ("2010 - 2012 гг.", "2010-01-01/2012-12-31 range"),
    ("2014-05 – 2014-09", "2014-05-01/2014-09-30 range"),
    ("from 2010 to 2012", "2010-01-01/2012-12-31 range"),
    ("2014-05-17", "2014-05-17/2014-05-17 day"),
    ("5 мая 2014", "2014-05-05/2014-05-05 day"),
    ("31 июня 2014", None),
    ("в феврале 2016 года", "2016-02-01/2016-02-29 month"),
    ("May of 2011", "2011-05-01/2011-05-31 month"),
    ("летом 2012", "2012-06-01/2012-08-31 season"),
    ("winter 2014", "2014-12-01/2015-02-28 season"),
    ("end of 2016", "2016-09-01/2016-12-31 part"),
    ("к концу 2016", "/2016-12-31 bound open"),
    ("начало 2016 г.", "2016-01-01/2016-05-01 part"),
    ("mid-2015", "2015-05-02/2015-09-01 part"),
    ("конец мая 2016", "2016-05-22/2016-05-31 part"),
    ("до 2011 г.", "/2011-12-31 bound open"),
    ("since March 2014", "2014-03-01/ bound open"),
    ("2014 - now", "2014-01-01/ range open"),
    ("с 2014 по настоящее время", "2014-01-01/ range open"),
    ("сейчас", "/ now open"),
    ("около 2013", "2013-01-01/2013-12-31 about"),
    ("1990-е годы", "1990-01-01/1999-12-31 decade"),
    ("1990s", "1990-01-01/1999-12-31 decade"),
    ("2001-2003, 2005-2007", "2001-01-01/2003-12-31 range; 2005-01-01/2007-12-31 range"),
    ("2007, 2001-2005, 2004 и 2006", "2001-01-01/2007-12-31 ranges"),
    ("2012 - now, 2001", "2001-01-01/2001-12-31 year; 2012-01-01/ range open"),
    ("2012 - now, 2015-2016", "2012-01-01/ ranges open"),
    ("не указано", ""),
    ("not given", ""),
    ("март", None),
    ("два года назад", None),
    ("2013-2010", None),
    ("2014-13", None),
    ("вскоре, 2015", None),
]


def test_when_spans(spark):
    rows = spark.createDataFrame([(k, x[0]) for k, x in enumerate(WHEN_SHAPES)], "k int, w string").select("k", times.when_spans(F.col("w")).alias("spans"))
    shown = lambda x: f"{x.first or ''}/{x.last or ''} {x.precision}{' open' if x.is_open else ''}"
    got = {x.k: None if x.spans is None else "; ".join(map(shown, x.spans)) for x in rows.collect()}
    assert {x[0]: got[k] for k, x in enumerate(WHEN_SHAPES)} == dict(WHEN_SHAPES)
    assert one(spark, times.when_spans(F.col("w")), w=None) is None


def test_escape_writes_ampersands_first(spark):
    assert one(spark, tx.escape(F.col("t")), t="a & b < c > \"d\" 'e' &lt;") == "a &amp; b &lt; c &gt; &#34;d&#34; &#39;e&#39; &amp;lt;"
    assert one(spark, tx.escape(F.col("t")), t=None) is None


@pytest.mark.parametrize(
    ("quote", "text", "found"),
    [
        ("A fox ran", "Then a FOX, ran off", True),
        ("a fox ... off", "Then a fox ran off.", True),
        ("a fox ... home", "Then a fox ran off.", False),
        ("", "anything", True),
    ],
)
def test_quoted_in(spark, quote, text, found):
    assert one(spark, tx.quoted_in(F.col("q"), F.col("t")), q=quote, t=text) is found


def test_missing_snippet_is_not_a_quote(spark):
    quotes = spark.createDataFrame([(1, 7, "a")], "quote_id int, snippet_id int, quote string")
    snippets = spark.createDataFrame([(8, "a")], "snippet_id int, text string")
    assert evidence.quote_check(quotes, snippets).first().found is False


def test_labels_fall_back_to_the_code_and_the_default(spark):
    edges = spark.createDataFrame([("a", "KNOWN", "b"), ("a", "RAW", "b"), ("a", None, "b")], "subject_id string, predicate string, object_id string")
    labels = spark.createDataFrame([("KNOWN", "knows")], "code string, label string")
    assert sorted(x.label for x in graph.labelled(edges, labels).collect()) == ["RAW", "knows", "linked"]


def test_edgeless_and_dangling(spark):
    entities = spark.createDataFrame([("a", "A", ["person"]), ("b", "b", ["club"]), ("c", "C", ["club", "person"])], "entity_id string, name string, types array<string>")
    edges = spark.createDataFrame([("a", "P", "b"), ("b", "P", "a"), ("a", "Q", "b"), ("a", "P", "x")], "subject_id string, predicate string, object_id string")
    assert [x.entity_id for x in graph.without_edges(entities, edges).collect()] == ["c"]
    assert [tuple(x) for x in graph.dangling(edges, entities).collect()] == [("x", 1)]
    assert graph.live(edges, entities).count() == 3
    bar = {x.page_id: x.bar for x in graph.neighbour_bar(edges, entities).collect()}
    assert bar["a"] == "b · x"
    assert sorted(x.colour for x in entities.select(tx.colour(F.col("types"), "person").alias("colour")).collect()) == ["green", "red", "red"]


def test_aliases_merge_spellings_and_keep_misses(spark):
    aliases = spark.createDataFrame([("ACME_CORP", "e1"), ("Acme Corp", "e1"), ("Other", "e2")], "surface string, entity_id string")
    mentions = spark.createDataFrame([("acme corp.",), ("nobody",)], "surface string")
    found = {x.surface: x.entity_id for x in resolve.resolve(mentions, aliases).collect()}
    assert found == {"acme corp.": "e1", "nobody": None}


def test_page_fields_skip_scripts_and_comments(spark):
    html = '<html lang="en"><title>T</title><script>var t="<h1>no</h1></p>";</script><!-- <h1>no</h1> --><h1>Head</h1><a href="/x"\n>X</a><p>end'
    table = spark.createDataFrame([(1, "https://h.example/p", html)], "page_id int, url string, html string")
    row = pages.titles(table).first()
    assert (row.host, row.lang, row.title, row.heading) == ("h.example", "en", "T", "Head")
    assert [(x.target, x.shown) for x in pages.links(table).collect()] == [("/x", "X")]
    assert pages.plain_text(table).first().text == "T Head X end"
