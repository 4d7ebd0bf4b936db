from collections import Counter

from frames import empty, frame, rows
from oracle import connection, same

from factloom.llm import mixing, queries


def test_query_matches_its_sql_twin(spark):
    sf_dir = "/root/testdata/sf0.01"
    same(queries.op4_mix_sources(spark, sf_dir), sf_dir, mixing.MIX_SQL)


def test_small_cells_keep_to_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 3)
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op4_mix_sources(spark, sf_dir).collect()
    again = queries.op4_mix_sources(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = dict(connection(sf_dir).sql("SELECT doc_id, source FROM documents").fetchall())
    taken, target, largest = Counter(), {}, Counter()
    for x in got:
        taken[source[x.doc_id]] += x.taken
        target[source[x.doc_id]] = x.target
        largest[source[x.doc_id]] = max(largest[source[x.doc_id]], x.size)
        assert 0 <= x.taken <= 3 * x.size
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    assert abs(sum(target.values()) - sum(x.size for x in got)) < 1e-3


def water(sizes, weights, cap=3):
    """Targets by sharing the excess again and again."""
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = float(sum(sizes.values())), {s for s in sizes}
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        share, left = left, 0.0
        for s in sorted(open_):
            target[s] += share * weights[s] / total
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
        open_ = {s for s in open_ if target[s] < cap * sizes[s]}
    return target


def test_targets_stop_and_are_shared_again(spark):
    sizes, weights = {"a": 10, "b": 1000, "c": 3, "d": 500, "e": 0}, {"a": 5, "b": 1, "c": 9, "d": 2, "e": 7}
    totals = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size bigint, weight bigint")
    got = {x.source: x.target for x in mixing.targets(totals, 3).collect()}
    expected = water(sizes, weights)
    assert all(abs(got[s] - expected[s]) < 1e-6 for s in sizes)


def test_awkward_rows(spark):
    got = mixing.mix(frame(spark)).collect()
    assert Counter(x.doc_id for x in got) == Counter(x[0] for x in rows())
    assert all(x.copies is not None and 0 <= x.copies <= 3 for x in got)
    assert all(x.size == 0 for x in got if x.doc_id in (7, 8, 9, 10, 100))
    assert {x.source for x in got} == {"src0", "src1", "src2", None}
    assert mixing.mix(empty(spark)).count() == 0
    given = spark.createDataFrame([("src0", 1), ("src1", 1), ("src2", 1), (None, 4)], "source string, weight int")
    assert len(mixing.mix(frame(spark), weights=given).collect()) == len(rows())
