import hashlib

from frames import empty, frame, rows

from factloom.llm import fingerprints as fp


def edited(table):
    order = sorted(table, key=lambda x: -x[0])
    out = {}
    for k, (own, text) in enumerate(order):
        n, following = len(text) // 3, order[(k + 1) % len(order)][1]
        out[own] = hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()
    return out


def test_edited_texts_and_likeness(spark, monkeypatch):
    table = {x[0]: x for x in rows() if x[0] is not None}
    df = frame(spark, list(table.values()))
    for size in (1 << 22, 2000):  # one bucket, many buckets
        monkeypatch.setattr(fp, "BUCKET_BYTES", size)
        found = {x.doc_id: x for x in fp.with_neighbours(df).collect()}
        assert {k: x.edited_sha256 for k, x in found.items()} == edited([(k, x[1] or "") for k, x in table.items()])
        assert all(x.n_chars == len(table[k][1] or "") for k, x in found.items())
        assert found[0].fingerprint == found[1].fingerprint == found[2].fingerprint
        assert found[7].fingerprint == found[8].fingerprint
        assert found[0].near_next == 1.0 or found[1].near_next == 1.0
        assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in found.values())
        assert found[14].near_edited > 0.6


def test_all_rows_stay(spark):
    found = fp.with_neighbours(frame(spark)).collect()
    assert len(found) == len(rows())
    assert fp.with_neighbours(empty(spark)).count() == 0
    assert [x.near_next for x in fp.with_neighbours(frame(spark, rows()[:1])).collect()] == [1.0]


def test_fingerprints_vote_by_count(spark):
    df = spark.createDataFrame([(1, "a b c d e a b c d e"), (2, "a b c d e"), (3, None)], "doc_id int, text string")
    found = {x.doc_id: x.fingerprint for x in fp.fingerprints(df).collect()}
    assert len(found) == 3
    assert all(len(x) == 32 for x in found.values())


def test_fingerprints_equal_plain_votes(spark):
    """Each bit by counting, over the terms' hashes as Spark gives them."""
    from pyspark.sql import functions as F

    table = {1: "A b c d e f g a b c d e", 2: "one two", 3: "x", 4: "to be or not to be or not to be that is the question"}
    terms = []
    for own, text in table.items():
        words = text.lower().split()
        terms += [(own, *(words[k : k + fp.SHINGLE] + [None] * fp.SHINGLE)[: fp.SHINGLE]) for k in range(len(words))]
    names = ["a", "b", "c", "d", "e"]
    hashed = spark.createDataFrame(terms, "own int, a string, b string, c string, d string, e string").withColumn("h", F.xxhash64(*names))
    votes = {}
    for x in hashed.select("own", "h", F.xxhash64("h").alias("g")).collect():
        votes.setdefault(x.own, []).append((x.h, x.g))
    expected = {}
    for own, found in votes.items():
        bits = [2 * sum(pair[half] >> k & 1 for pair in found) > len(found) for half in (0, 1) for k in [*range(32, 64), *range(32)]]
        expected[own] = f"{int(''.join(map(str, map(int, bits))), 2):032x}"
    df = spark.createDataFrame(list(table.items()), "doc_id int, text string")
    assert {x.doc_id: x.fingerprint for x in fp.fingerprints(df).collect()} == expected


def test_buckets_follow_the_order_of_ids(spark, monkeypatch):
    """Spread, clustered, repeated and null ids: the next text is right whatever the buckets."""
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(5)
    monkeypatch.setattr(fp, "BUCKET_BYTES", 300)
    kinds = {"spread": lambda: rnd.randrange(-(1 << 62), 1 << 62), "clustered": lambda: rnd.choice([7, 1 << 40, -(1 << 63), (1 << 63) - 1]) if rnd.random() < 0.5 else rnd.randrange(50), "one": lambda: 3, "null": lambda: None}
    for make in kinds.values():
        table = [(make(), f"text {k} {rnd.random()}") for k in range(150)]
        df = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
        marks = {x.text: x.h for x in df.select("text", F.xxhash64("text").alias("h")).collect()}
        order = sorted(table, key=lambda x: (1 << 63 if x[0] is None else -x[0], marks[x[1]]))
        found = fp.in_order(df, "doc_id", "text").where("halo = 0").collect()
        assert {x.text: x.following for x in found} == {order[k][1]: order[(k + 1) % len(order)][1] for k in range(len(order))}
        assert len({x.bucket for x in found}) > 5


def test_search_finds_all_within_the_radius(spark):
    import random

    rnd = random.Random(1)
    near = lambda x, n: x ^ sum(1 << k for k in rnd.sample(range(128), n))
    base = [rnd.getrandbits(128) for _ in range(40)]
    every = base + [near(x, n) for x in base for n in (1, 2, 3, 4, 9)]
    table = spark.createDataFrame([(f"{x:032x}",) for x in every + base] + [(None,)], "fingerprint string")
    queries = spark.createDataFrame([(f"{x:032x}",) for x in base], "fingerprint string")
    expected = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in base for b in every if (a ^ b).bit_count() <= 3}
    for blocks in (4, 6):
        found = [tuple(x) for x in fp.search(table, queries, 3, blocks).collect()]
        assert len(found) == len(set(found))
        assert set(found) == expected
    wide = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in base for b in every if (a ^ b).bit_count() <= 6}
    assert {tuple(x) for x in fp.search(table, queries, 6, 8).collect()} == wide


def test_rows_within_the_radius_are_counted(spark):
    from pyspark.sql import functions as F

    table = [(k, f"{x:032x}") for k, x in enumerate([0, 0, 1, 3, 7, 15, 31 << 60, 0])] + [(None, f"{0:032x}")]
    df = spark.createDataFrame(table, "doc_id bigint, fingerprint string")
    got = {x.doc_id: x.n_within for x in fp.count_within(df, F.col("doc_id") % 2 == 0, 3).collect()}
    value = lambda x: int(x[1], 16)
    expected = {x[0]: sum((value(x) ^ value(y)).bit_count() <= 3 for y in table) if x[0] is not None and x[0] % 2 == 0 else None for x in table}
    assert got == expected
    least = lambda x: min(y[0] for y in table if y[0] is not None and (value(x) ^ value(y)).bit_count() <= 3)
    assert {x.doc_id: x.first_within for x in fp.count_within(df, F.col("doc_id") % 2 == 0, 3).collect()} == {x[0]: least(x) if x[0] is not None and x[0] % 2 == 0 else None for x in table}
    assert fp.count_within(df.limit(0), F.col("doc_id") % 2 == 0).count() == 0


def test_search_shuffles_numbers_and_broadcasts_no_tables(spark):
    """What each of the tables carries through the shuffle is two halves and a key, whatever the size of the sides."""
    rows = spark.createDataFrame([(f"{k * 0x9E3779B97F4A7C15F39CC0605CEDC835 % (1 << 128):032x}",) for k in range(50)], "fingerprint string")
    found = fp.search(rows, rows.limit(5), 6, 8)
    assert sorted(x.distance for x in found.collect()) == [0] * 5
    physical = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [key" in physical and "Broadcast" not in physical
