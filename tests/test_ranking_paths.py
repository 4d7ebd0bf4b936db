import random
from collections import defaultdict

from pyspark.sql import functions as F

from factloom.operators import components, evidence, graph, pages, paths, ranking, resolve
from factloom.sources import tables as tb
from factloom.staging import Rounds, path_exists


def test_hubs_are_numbered_like_other_pages(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hub"] * 6 + ["a", "b", None]), rnd.choice([None, *"abcdefgh"]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "page string, name string, k int")
    plain = {x.k: x.position for x in ranking.ranked(df, ["page"], ["name", "k"]).collect()}
    by_page = defaultdict(list)
    for page, name, k in rows:
        by_page[page].append((name is not None, name or "", k))
    expected = {k: n for found in by_page.values() for n, (_, _, k) in enumerate(sorted(found), 1)}
    assert plain == expected
    cut = ranking.ranked(df, ["page"], ["name", "k"], hub_rows=100)
    assert {x.k: x.position for x in cut.collect()} == expected
    assert cut.columns == ["page", "name", "k", "position"]


def test_no_task_ranks_a_whole_hub(spark, monkeypatch):
    """The rows of a hub lie in ranges of about hub_rows, which is what is numbered at once."""
    written = {}
    keep = ranking.materialise
    monkeypatch.setattr(ranking, "materialise", lambda df, name: written.setdefault(name, keep(df, name)))
    df = spark.range(20_000).select(F.lit("hub").alias("page"), "id")
    found = ranking.ranked(df, ["page"], ["id"], hub_rows=1000)
    assert found.where("position <> id + 1").isEmpty()
    sizes = [x["count"] for x in written["ranges"].groupBy("page", "_range").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 4000


def test_graph_with_hubs_equals_the_one_without(spark, sf_dir):
    edges, facts, entities, labels, snippets = tb.edges(spark, sf_dir).cache(), tb.facts(spark, sf_dir).cache(), tb.entities(spark, sf_dir), tb.predicate_labels(spark), tb.snippets(spark, sf_dir)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(graph.sections(edges, entities, labels), graph.sections(edges, entities, labels, hub_rows=40))
    assert same(evidence.footnotes(facts), evidence.footnotes(facts, hub_rows=40))
    assert same(evidence.numbered(facts), evidence.numbered(facts, hub_rows=40))
    made = [pages.profiles(entities, edges, facts, snippets, labels, "customer", part_lines=30, hub_rows=n) for n in (40, None)]
    assert same(*made)
    assert made[0].where("part > 1").count() > 5
    assert made[0].groupBy("file_name").count().where("count > 1").isEmpty()


def plain_distances(links, starts):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    best = {s: [s] for s in starts}
    level = sorted(starts)
    while level:
        found = {}
        for node in level:
            for other in near[node]:
                if other not in best:
                    path = [*best[node], other]
                    found[other] = min(found.get(other, path), path)
        best |= found
        level = sorted(found)
    return best


def test_paths_equal_a_plain_search(spark):
    rnd = random.Random(2)
    for n, m in ((12, 8), (40, 50), (60, 45)):
        links = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)]
        edges = spark.createDataFrame([(a, "P", b) for a, b in links], "subject_id string, predicate string, object_id string")
        starts = ["n0", "n1", "n1", "alone", None]
        got = paths.least_paths(edges, spark.createDataFrame([(x,) for x in starts], "entity_id string")).collect()
        expected = plain_distances(links, {"n0", "n1", "alone"})
        assert {x.node: x.path for x in got} == expected and len(got) == len(expected)
        assert all(x.distance == len(x.path) - 1 and x.parent == (x.path[-2] if x.distance else None) for x in got)
        near = paths.least_paths(edges, spark.createDataFrame([("n0",)], "entity_id string"), farthest=1)
        assert {x.distance for x in near.collect()} <= {0, 1}
    none = spark.createDataFrame([], "subject_id string, predicate string, object_id string")
    assert paths.least_paths(none, spark.createDataFrame([], "entity_id string")).count() == 0


def test_components_of_names(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "z"), (None, "a")], "u string, v string")
    assert {x.node: x.root for x in components.components(links).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_rounds_keep_one_table(spark):
    rounds = Rounds(spark, "test-rounds")
    one = rounds.write(spark.range(3))
    first = rounds.folder
    two = rounds.write(one.where("id > 0"))
    assert two.count() == 2 and not path_exists(spark, first)
    rounds.drop()
    assert rounds.folder is None


def test_chains_and_circles_of_names(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", None), ("e", "c"), ("p", "q"), ("q", "r"), ("r", "q"), ("s", "s"), ("t", "v"), ("t", "u"), ("t", "u")]
    same = spark.createDataFrame(pairs, "entity_id string, stands_for string")
    assert {x.entity_id: x.root for x in resolve.canonical_ids(same).collect()} == {"a": "d", "b": "d", "c": "d", "e": "d", "q": "p", "r": "p", "t": "u"}
    long = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(200)], "entity_id string, stands_for string")
    assert {x.root for x in resolve.canonical_ids(long).collect()} == {"n200"}
    assert resolve.canonical_ids(same.where("false")).count() == 0


def test_headings_of_one_entity_become_one(spark):
    edges = spark.createDataFrame([("a", "P", "x"), ("b", "P", "x"), ("c", "Q", "x"), ("a", "P", "b"), ("y", "P", None), ("x", "P", "a")], "subject_id string, predicate string, object_id string")
    roots = spark.createDataFrame([("a", "c"), ("b", "c")], "entity_id string, root string")
    got = sorted(map(repr, (tuple(x) for x in resolve.canonical_edges(edges, roots).collect())))
    assert got == sorted(map(repr, [("c", "P", "x", 2), ("c", "Q", "x", 1), ("y", "P", None, 1), ("x", "P", "c", 1)]))
