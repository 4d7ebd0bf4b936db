import random

import numpy as np
import pyarrow as pa
import pytest
from frames import empty, frame, rows
from oracle import same

from factloom.llm import ngram_join as nj
from factloom.llm import queries
from factloom.operators.components import components


def brute(table, shingle, percent):
    """component of each row's number: links between shingle sets, then all that can be reached."""
    sets = []
    for _, text in table:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + shingle]) for k in range(len(words) - shingle + 1)} if len(words) >= shingle else {tuple(words)} - {()})
    root = list(range(len(table)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(table)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for k, (own, _) in enumerate(table):
        ids = [table[j][0] for j in range(len(table)) if find(j) == find(k) and table[j][0] is not None]
        out.append((own, len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=repr)


#: No shingle is known as frequent.
NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def found(df, **options):
    return sorted(map(tuple, nj.link_components(df, **options).collect()), key=repr)


def copies(seed, bases, each, words, edits):
    rnd = random.Random(seed)
    out = []
    for _ in range(bases):
        base = [f"w{rnd.randrange(3000)}" for _ in range(words)]
        for _ in range(each):
            text = list(base)
            for _ in range(rnd.randrange(edits + 1)):
                text[rnd.randrange(words)] = f"v{rnd.randrange(10**6)}"
            out.append((len(out), " ".join(text)))
    return out


def test_awkward_rows(spark):
    table = [(x[0], x[1]) for x in rows()]
    assert found(frame(spark)) == brute(table, 4, 85)
    assert found(frame(spark), shingle=5, percent=80) == brute(table, 5, 80)
    assert found(empty(spark)) == []


@pytest.mark.parametrize(("chunk", "paired", "frequent"), [(256, 16, 8), (8, 3, 2)])
def test_groups_of_near_copies(spark, monkeypatch, chunk, paired, frequent):
    """Also with blocks split into many chunks and order steered by other counts."""
    monkeypatch.setattr(nj, "CHUNK", chunk)
    monkeypatch.setattr(nj, "PAIRED", paired)
    monkeypatch.setattr(nj, "FREQUENT_FROM", frequent)
    monkeypatch.setattr(nj, "PIVOTS", 2)
    table = copies(1, 6, 30, 120, 9) + [(1000 + k, x) for k, x in copies(2, 4, 6, 40, 4)]
    shared = " ".join(f"s{k}" for k in range(60))
    table += [(2000 + k, f"{shared} {x}") for k, x in copies(3, 30, 1, 25, 0)]
    df = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
    assert found(df) == brute(table, 4, 85)


def test_tree_walk_equals_plain_comparison():
    rnd = random.Random(3)
    pool = [np.array(sorted(rnd.sample(range(60), rnd.randrange(1, 40))), np.uint64) for _ in range(60)]
    pool += [np.array(sorted({*x.tolist()} ^ {rnd.randrange(60)}), np.uint64) for x in pool[:30]]
    sets = sorted((tuple(int(v) for v in x), k) for k, x in enumerate(pool) if len(x))
    tree = nj.Tree.build(sets)
    for ranks, _ in sets:
        expected = {k for other, k in sets if 100 * len({*ranks} & {*other}) >= 85 * len({*ranks} | {*other})}
        assert set(nj.matches(tree, ranks, 85)) == expected


def test_prefixes_and_trees_follow_one_order():
    """The order depends on the corpus's counts alone, not on what a block holds."""
    frequent, times = np.array([3, 5, 9], np.uint64), np.array([4, 7, 4])
    tokens = np.arange(12, dtype=np.uint64)
    whole = tokens[nj.global_order(tokens, frequent, times)[0]].tolist()
    assert whole == [0, 1, 2, 4, 6, 7, 8, 10, 11, 3, 9, 5]
    for part in ([5, 9, 1], [3, 11, 5, 0], [9, 3]):
        own = np.array(sorted(part), np.uint64)
        assert own[nj.global_order(own, frequent, times)[0]].tolist() == [x for x in whole if x in part]


def test_join_links_whatever_is_known_as_frequent():
    rnd = random.Random(8)
    base = rnd.sample(range(10**6), 80)
    sets = [np.array(sorted({*base[: 80 - k % 9], *rnd.sample(range(10**6), k % 7)}), np.uint64) for k in range(40)]
    linked = {(a, b) for a in range(40) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert 0 < len(linked) < 780

    def together(links):
        root = list(range(40))
        for a, b in list(links) * 40:
            root[a] = root[b] = min(root[a], root[b])
        return root

    for frequent, times in (NONE, (np.array(sorted(base), np.uint64), np.arange(80) % 5 + 3)):
        got = nj.join([(k, x, False, k) for k, x in enumerate(sets)], 85, frequent, times)
        assert {(max(x), min(x)) for x in got} <= linked
        assert together(got) == together(linked)


def test_components(spark):
    rnd = random.Random(4)
    links = [(k, k + 1) for k in range(0, 60) if k % 13] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)] + [(7, 7), (None, 3)]
    root = {}
    for a, b in links:
        if a is not None and a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert {x.node: x.root for x in components(df).collect()} == {k: find(k) for k in root}
    assert components(df.limit(0)).count() == 0


def test_sets_outside_the_largest_component_are_stored_and_probe():
    """Two sets of one part and two chunks, each in the other's group as a probe and in its own as both."""
    x, y = np.arange(20, dtype=np.uint64).tobytes(), np.arange(1, 21, dtype=np.uint64).tobytes()
    both = [(True, 0), (True, 1), (False, 0), (False, 1)]
    table = [(7, chunk, k, t, probe, k) for probe, chunk in both for k, t in ((1, x), (2, y)) if probe or chunk == k - 1]
    table.sort(key=lambda row: (row[1], not row[4]))  # probe copies come first
    batch = pa.RecordBatch.from_pylist([dict(zip(("block", "chunk", "set_id", "tokens", "probe", "component"), row, strict=True)) for row in table])
    links = {frozenset(row.values()) for out in nj._joined(85, *NONE)([batch]) for row in out.to_pylist()}
    assert links == {frozenset((1, 2))}


def test_a_large_block_of_many_small_pairs(spark, monkeypatch):
    """Pairs that link with nothing else, spread over the chunks of one block."""
    monkeypatch.setattr(nj, "CHUNK", 64)
    monkeypatch.setattr(nj, "PIVOTS", 2)
    monkeypatch.setattr(nj, "FREQUENT_FROM", 10**9)  # the shared passage is not known as frequent
    shared = " ".join(f"s{k}" for k in range(50))
    table = [(k, f"{shared} {x}") for k, x in copies(5, 1, 60, 25, 1)]
    for k, x in copies(6, 32, 1, 25, 0):
        table += [(1000 + 2 * k, f"{shared} {x}"), (1001 + 2 * k, f"{shared} {x} end")]
    df = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
    assert found(df) == brute(table, 4, 85)


def test_a_large_block_of_pairs_of_many_sizes(spark, monkeypatch):
    """Pairs outside the largest component whose sizes lie at the edge of what may link, in levels of several chunks."""
    monkeypatch.setattr(nj, "CHUNK", 8)
    monkeypatch.setattr(nj, "PIVOTS", 1)
    monkeypatch.setattr(nj, "PAIRED", 3)
    monkeypatch.setattr(nj, "FREQUENT_FROM", 10**9)
    shared = " ".join(f"s{k}" for k in range(50))
    table = [(k, f"{shared} {x}") for k, x in copies(9, 1, 30, 30, 1)]
    for k, x in copies(10, 40, 1, 40, 0):
        words = x.split()[: 12 + k % 28]
        text = f"{shared} {' '.join(words)}"
        shingles = len(text.split()) - 3
        more = (100 * shingles // 85 - shingles) + k % 2  # just enough, or one too many, for a link
        table += [(1000 + 2 * k, text), (1001 + 2 * k, f"{text} {' '.join(f'e{k}x{j}' for j in range(more))}")]
    df = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
    assert found(df) == brute(table, 4, 85)


def test_words_that_a_polynomial_hash_confuses(spark):
    """A Thue-Morse word of a and b and its complement share a polynomial hash modulo 2**64; they must not link."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, f"{word} x y z"), (2, f"{other} x y z")], "doc_id bigint, text string")
    assert sorted((x.doc_id, x.component_id) for x in nj.link_components(df).collect()) == [(1, 1), (2, 2)]


def test_query_matches_its_sql_twin(spark, sf_dir):
    same(queries.op3_ngram_join(spark, sf_dir), sf_dir, queries.ORACLES["op3_ngram_join"])


def test_few_links_take_few_tasks(spark):
    # 60 shuffle partitions that are not put together: a round of few links writes few parts and shuffles links once
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a bigint, b bigint").coalesce(2)
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    context = spark.sparkContext
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        context.setJobGroup("few-links", "few links")
        got = {x.node: x.root for x in components(links).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    status = context.statusTracker()
    stages = {s for job in status.getJobIdsForGroup("few-links") for s in status.getJobInfo(job).stageIds}
    infos = [x for x in map(status.getStageInfo, stages) if x]
    tasks = sum(x.numCompletedTasks for x in infos)
    assert infos and tasks <= 2000, tasks


def test_rounds_with_and_without_broadcast_agree(spark, monkeypatch):
    from factloom.operators import components as c

    links = spark.createDataFrame([(k % 50, (k * 7 + 3) % 61) for k in range(0, 90, 2)], "a bigint, b bigint")
    few = sorted(map(tuple, components(links).collect()))
    monkeypatch.setattr(c, "BROADCAST_LINKS", 0)
    assert sorted(map(tuple, components(links).collect())) == few


def test_links_of_a_group_are_stars():
    assert sorted(nj.stars([(5, 4), (4, 3), (9, 8), (3, 7), (4, 7)])) == [(4, 3), (5, 3), (7, 3), (9, 8)]
    assert nj.stars([]) == []
