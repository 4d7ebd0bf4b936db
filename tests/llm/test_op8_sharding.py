import pytest
from frames import empty, frame, rows
from pyspark.sql import functions as F

from factloom.llm import queries
from factloom.llm.common import shared_folder
from factloom.llm.sharding import FAN_IN, Conflict, ShardStore


def store(spark, target=1 << 20, small=1 << 10):
    return ShardStore(spark, shared_folder(spark, "test-shards"), target, small)


def content(df):
    return sorted(map(repr, df.collect()))


def arrivals(spark, n):
    return frame(spark).withColumn("__arrival", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))


def test_rows_survive_appends_and_compaction(spark):
    own, df = store(spark), frame(spark)
    assert own.append(arrivals(spark, 6), "__arrival") == 1
    version = own.compact(df.schema)
    assert version >= 2
    assert own.append(arrivals(spark, 3), "__arrival") == version + 1
    own.compact(df.schema)
    _, shards = own.manifest()
    assert sum(x.rows for x in shards) == 2 * len(rows())
    assert not own.plan(shards)
    assert content(own.read(shards, df.schema)) == content(df.unionByName(df))
    known = {x.name: x for x in shards}
    located = own.located(df.schema).collect()
    assert len(located) == 2 * len(rows())
    assert all(x.located.rows == known[x.located.name].rows and x.located.tier == known[x.located.name].tier for x in located)


def test_versions_are_committed_once(spark):
    own = store(spark)
    own.append(arrivals(spark, 2), "__arrival")
    version, shards = own.manifest()
    with pytest.raises(Conflict):
        own.commit(version, shards)
    assert own.manifest() == (version, shards) and sum(x.rows for x in shards) == len(rows())
    assert own.versions() == [version]


def test_old_versions_are_read_until_they_are_deleted(spark):
    own, df = store(spark), frame(spark)
    own.append(arrivals(spark, FAN_IN + 2), "__arrival")
    base, first = own.manifest()
    runs = own.plan(first)
    assert runs and all(len(x) >= FAN_IN for x in runs)
    own.merge(base, runs, df.schema)
    assert content(own.read(first, df.schema)) == content(df)
    assert own.vacuum() == 0
    assert content(own.read(first, df.schema)) == content(df)
    assert own.vacuum(grace_seconds=0) == sum(len(x) for x in runs)
    assert content(own.read(own.manifest()[1], df.schema)) == content(df)


def test_shards_of_another_writer_survive(spark):
    """A writer has written its shards, another one compacts and vacuums, then the first one commits."""
    own, other, df = store(spark), None, frame(spark)
    own.append(arrivals(spark, FAN_IN + 2), "__arrival")
    other = ShardStore(spark, own.path, own.target_bytes, own.small_bytes)
    df.withColumn("n", F.lit(0)).write.partitionBy("n").parquet(f"{own.path}/shards/late")
    version = other.compact(df.schema)
    other.vacuum()
    (late,) = own._written("late", "n", df.withColumn("n", F.lit(0)).schema, version + 1)
    own.commit(version + 1, [late[1]])
    assert content(own.located(df.schema).drop("located")) == content(df.unionByName(df))


def test_two_writers_that_compact_keep_each_row_once(spark):
    own, df = store(spark), frame(spark)
    own.append(arrivals(spark, FAN_IN + 2), "__arrival")
    other = ShardStore(spark, own.path, own.target_bytes, own.small_bytes)
    base, shards = own.manifest()
    runs = own.plan(shards)
    other.compact(df.schema)
    with pytest.raises(Conflict):
        own.merge(base, runs, df.schema)
    assert content(own.located(df.schema).drop("located")) == content(df)
    # the other order: one plans and merges while the other has planned the same and comes second
    own.append(arrivals(spark, FAN_IN + 3), "__arrival")
    base, shards = own.manifest()
    runs = other.plan(shards)
    assert own.merge(base, runs, df.schema) == base + 1
    with pytest.raises(Conflict):
        other.merge(base, runs, df.schema)
    assert other.compact(df.schema) == own.last()
    assert content(own.located(df.schema).drop("located")) == content(df.unionByName(df))


def test_a_merge_that_was_overtaken_is_planned_again(spark, monkeypatch):
    own, df = store(spark), frame(spark)
    own.append(arrivals(spark, FAN_IN + 2), "__arrival")
    other = ShardStore(spark, own.path, own.target_bytes, own.small_bytes)
    merge, overtaken = own.merge, []

    def slow(base, runs, schema):
        if not overtaken:
            overtaken.append(other.append(arrivals(spark, 2), "__arrival"))
        return merge(base, runs, schema)

    monkeypatch.setattr(own, "merge", slow)
    assert own.compact(df.schema) > overtaken[0]
    assert content(own.located(df.schema).drop("located")) == content(df.unionByName(df))


def test_appends_at_one_time_all_come(spark):
    from concurrent.futures import ThreadPoolExecutor

    own, df = store(spark), frame(spark)
    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(lambda _: ShardStore(spark, own.path, own.target_bytes, own.small_bytes).append(arrivals(spark, 2), "__arrival"), range(3)))
    assert sorted(versions) == [1, 2, 3]
    assert sum(x.rows for x in own.manifest()[1]) == 3 * len(rows())
    assert {x.version for x in own.manifest()[1]} == {1, 2, 3}


def plain_runs(own, shards):
    """Runs of each tier by their rule: in order of arrival, ended as soon as bytes and files suffice, the rest if its files do."""
    runs = []
    for tier in sorted({x.tier for x in shards}):
        waiting = sorted((x for x in shards if x.tier == tier and not own.done(x)), key=lambda x: (x.version, x.name))
        while waiting:
            n = next((n for n in range(1, len(waiting) + 1) if sum(x.bytes for x in waiting[:n]) >= own.target_bytes and sum(x.files for x in waiting[:n]) >= FAN_IN), len(waiting))
            if sum(x.files for x in waiting[:n]) >= FAN_IN:
                runs.append(waiting[:n])
            waiting = waiting[n:]
    return runs


def test_plans_and_tiers_equal_the_plain_ones(spark):
    import random

    from factloom.llm.sharding import Shard

    rnd = random.Random(4)
    for _ in range(300):
        own = ShardStore(spark, "unused", rnd.choice([100, 1000, 10_000]), rnd.choice([1, 10]))
        shards = []
        for k in range(rnd.randrange(40)):
            size, files = rnd.randrange(1, 3000), rnd.randrange(1, 4)
            tier = next(t for t in range(50) if size / files < own.small_bytes * FAN_IN ** (t + 1))
            assert own.tier(size / files) == tier
            shards.append(Shard(f"s{k}", 1, size, tier, rnd.randrange(1, 5), files))
        runs = own.plan(shards)
        assert runs == plain_runs(own, shards)
        named = [x.name for run in runs for x in run]
        assert len(named) == len(set(named))
        assert all(len({x.tier for x in run}) == 1 for run in runs)


def test_clashing_names_stay_as_they_are(spark):
    own = store(spark)
    names = ("shard", "tier", "version", "name", "rows", "file", "run", "arrival", "__run", "__arrival_", "ARRIVAL_")
    df = frame(spark).withColumns({x: F.concat(F.lit(x), F.col("doc_id")) for x in names})
    own.append(df.withColumn("__a", F.pmod(F.xxhash64("doc_id", "text"), F.lit(FAN_IN + 2))), "__a")
    assert own.compact(df.schema) > 1
    assert content(own.located(df.schema).drop("located")) == content(df)
    with pytest.raises(ValueError):
        own.located(df.schema, into="Tier")


def test_large_shards_are_left_alone(spark):
    own = store(spark, target=10)
    own.append(arrivals(spark, 6), "__arrival")
    assert own.compact(frame(spark).schema) == 1


def test_empty_tables_and_null_arrivals(spark):
    own = store(spark)
    own.append(empty(spark).withColumn("__arrival", F.lit(0)), "__arrival")
    assert own.manifest()[1] == []
    assert own.located(empty(spark).schema).count() == 0
    own.append(frame(spark).withColumn("a", F.lit(None).cast("int")), "a")
    assert sum(x.rows for x in own.manifest()[1]) == len(rows())


def test_query_keeps_every_text(spark):
    import hashlib

    sf_dir = "/root/testdata/sf0.001"
    docs = {x.doc_id: hashlib.sha256((x.text or "").encode()).hexdigest() for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {x.doc_id: x.text_sha256 for x in queries.op8_sharding(spark, sf_dir).collect()} == docs


def test_small_files_of_a_large_shard_are_merged(spark):
    own, df = store(spark), frame(spark, parts=8)
    own.append(df.withColumn("__arrival", F.lit(0)), "__arrival")
    (shard,) = own.manifest()[1]
    assert shard.files >= FAN_IN
    own.target_bytes = shard.bytes - 1
    assert own.compact(df.schema) == 2
    (merged,) = own.manifest()[1]
    assert merged.files == 1
    assert content(own.read([merged], df.schema)) == content(df)


def test_arrivals_grow_with_the_input():
    assert queries.arrivals_of(0) == queries.WAVES
    for size in (10**9, 30 * 10**9):
        assert size / sum(queries.arrivals_of(size)) <= queries.ARRIVAL_BYTES < queries.SHARD_BYTES / 2
