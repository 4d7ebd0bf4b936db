import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import sketches
from factloom.sinks import site
from factloom.sources import tables as tb
from factloom.staging import shared_folder
from factloom.streaming import upkeep

FACTS = "fact_id int, ts timestamp, subject_id string, predicate string, object_id string"


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def rebuilt(spark, rows):
    facts = spark.createDataFrame(rows, FACTS)
    sides = facts.select("*", F.inline(F.array(F.struct(F.col("subject_id").alias("page_id"), F.col("object_id").alias("other_id")), F.struct(F.col("object_id").alias("page_id"), F.col("subject_id").alias("other_id")))))
    return sorted(map(tuple, upkeep.summary(sides).collect()))


def test_pages_after_replayed_late_and_doubled_batches_equal_a_rebuild(spark):
    rnd = random.Random(1)
    page = lambda: f"p{rnd.randrange(15)}"
    batches = [[(100 * b + k, at(24 * b + rnd.randrange(24)), page(), "P", page()) for k in range(20)] for b in range(4)]
    batches[1] += [batches[0][3], batches[1][0], batches[1][0]]  # comes again, and twice at once
    too_late = (900, at(-500), "p1", "P", "p2")
    in_time = (901, at(24 + 12), "p1", "P", "new page")
    batches[3] += [too_late, in_time, batches[2][5], (None, at(70), "p1", "P", "p1")]
    keep = upkeep.PageUpkeep(spark, shared_folder(spark, "test-upkeep"), "3 days")
    for number, rows in enumerate(batches):
        keep(spark.createDataFrame(rows, FACTS), number)
        if number == 2:
            keep(spark.createDataFrame(rows, FACTS), number)  # as after a failure
            before = {x.page_id for x in keep.table("pages").collect()}
    taken = {x[0]: x for rows in batches for x in rows if x[0] is not None and x[0] != 900}
    assert sorted(map(tuple, keep.pages().collect())) == rebuilt(spark, list(taken.values()))
    assert [x.fact_id for x in keep.table("late").collect()] == [900]
    assert "new page" not in before
    touched = {p for x in batches[3] if x[0] not in (None, 900) and x[0] != batches[2][5][0] for p in (x[2], x[4])}
    assert {x.page_id for x in keep.table("pages").where("batch = 3").collect()} == touched
    keep(spark.createDataFrame([], FACTS), 4)
    assert keep.pages().count() == len({p for x in taken.values() for p in (x[2], x[4])})


def test_a_stream_of_files_keeps_pages(spark, tmp_path):
    rows = [(k, at(k), f"p{k % 5}", "P", f"q{k % 3}") for k in range(30)]
    for b in range(3):
        spark.createDataFrame(rows[10 * b : 10 * b + 10] + rows[:3], FACTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keep = upkeep.PageUpkeep(spark, str(tmp_path / "pages"), "30 days")
    assert sorted(map(tuple, keep.run(stream, str(tmp_path / "checkpoint")).collect())) == rebuilt(spark, rows)
    assert keep.table("marks").count() == 3


def test_a_site_has_each_page_once(spark, tmp_path):
    pages = spark.range(40).select(F.format_string("entity-%d.html", "id").alias("file_name"), F.concat(F.lit("<p>ж"), F.col("id")).alias("html"), F.lit(1).alias("more")).repartition(4)
    path = str(tmp_path / "site")
    site.write_site(pages, path)
    names = sorted(x for x in os.listdir(path) if not x.startswith("_"))
    assert names == sorted(f"entity-{k}.html" for k in range(40))
    assert (tmp_path / "site" / "entity-7.html").read_text() == "<p>ж7"
    assert os.listdir(tmp_path / "site" / site.BESIDE) == []
    with pytest.raises(Exception, match="there already"):
        site.write_site(pages, path)
    site.write_site(pages.limit(3).withColumn("html", F.lit(None).cast("string")), path, "overwrite")
    assert len([x for x in os.listdir(path) if x.endswith(".html")]) == 40
    assert sum(not (tmp_path / "site" / x).read_text() for x in names) == 3
    site.write_site(pages.where("false"), path)


def test_a_failed_task_leaves_no_page(spark, tmp_path):
    path = str(tmp_path / "site")
    bad = spark.range(40).select(F.when(F.col("id") == 33, "a/b").otherwise(F.format_string("e-%d.html", "id")).alias("file_name"), F.lit("x").alias("html")).repartition(3)
    with pytest.raises(Exception, match="no name of a page"):
        site.write_site(bad, path)
    assert [x for x in os.listdir(path) if not x.startswith("_")] == []
    twice = spark.createDataFrame([("a.html", "1"), ("a.html", "2")], "file_name string, html string").repartition(2)
    with pytest.raises(Exception, match="one name"):
        site.write_site(twice, path)
    assert [x for x in os.listdir(path) if not x.startswith("_")] == []
    with pytest.raises(Exception, match="file_name"):
        spark.dataSource.register(site.SiteDataSource)
        spark.range(1).write.format("site").mode("append").option("path", path).save()


def test_an_attempt_that_ran_twice_counts_once(tmp_path):
    from pyspark.sql import Row

    writer = site.SiteWriter(str(tmp_path), False)
    rows = [Row(file_name=f"p{k}.html", html=str(k)) for k in range(5)]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    writer.commit([kept, None])
    assert sorted(x for x in os.listdir(tmp_path) if x.endswith(".html")) == [f"p{k}.html" for k in range(5)]
    assert not os.path.exists(tmp_path / lost.folder)


def test_sketches_merge_to_what_the_rows_give(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    kept = sketches.stored(rows, ["day", "event_type"], "user_id", "value")
    for by in ([], ["event_type"], ["day"]):
        got = {tuple(x[c] for c in by): x for x in sketches.rolled(kept, by).select(*by, "n", sketches.distinct_count().alias("users"), sketches.quantile(0.9).alias("high")).collect()}
        true = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sort_array(F.collect_list("value")).alias("values")).collect()
        assert len(got) == len(true)
        for x in true:
            own = got[tuple(x[c] for c in by)]
            assert own.n == x.n and abs(own.users - x.users) <= max(1, 0.05 * x.users)
            assert sum(v <= own.high for v in x["values"]) / x.n == pytest.approx(0.9, abs=0.03 + 1 / x.n)
    nulls = spark.createDataFrame([(None, None, None), ("a", None, 2.0)], "k string, u int, v double")
    found = {x.k: x for x in sketches.stored(nulls, ["k"], "u", "v").select("k", "n", sketches.distinct_count().alias("d"), sketches.quantile(0.5).alias("q")).collect()}
    assert (found[None].n, found[None].d, found[None].q, found["a"].q) == (1, 0, None, 2.0)
    assert sketches.cubed(kept, ["day", "event_type"]).where("level = 3").count() == 1
