import pytest
from oracle import same

from factloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql_twin(spark, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir), sf_dir, catalog.ORACLES[name])


def test_flagship_profile(spark, sf_dir):
    rows = catalog.flagship(spark, sf_dir).collect()
    assert rows
    assert [x.position for x in rows] == list(range(1, len(rows) + 1))
    assert {x.direction for x in rows} == {"out"}


def test_invariants_of_the_graph(spark, sf_dir):
    from pyspark.sql import functions as F

    from factloom.operators import evidence, graph
    from factloom.sources import tables as tb

    edges, facts = tb.edges(spark, sf_dir), tb.facts(spark, sf_dir)
    sides = graph.both_ends(edges)
    assert sides.count() == 2 * edges.count()
    assert sides.where("direction = 'out'").select("page_id").exceptAll(edges.select("subject_id")).isEmpty()
    bar = graph.neighbours(edges)
    assert bar.count() == bar.distinct().count()
    notes = evidence.footnotes(facts)
    spread = notes.groupBy("page_id").agg(F.min("number").alias("a"), F.max("number").alias("b"), F.count("*").alias("n"))
    assert spread.where("a <> 1 OR b <> n").isEmpty()
    links = evidence.numbered(facts).groupBy("subject_id", "back_link").count()
    assert links.where("count > 1").isEmpty()
