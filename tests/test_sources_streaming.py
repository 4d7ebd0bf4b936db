from factloom.operators import pages
from factloom.sources import files
from factloom.sources import tables as tb
from factloom.streaming import events as ev


def test_uploads_get_short_ids(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("three")
    rows = files.uploads(spark, str(tmp_path)).collect()
    assert {x.file_name: x.text for x in rows} == {"a.txt": "one\ntwo", "b.txt": "three"}
    assert all(len(x.upload_id) == 6 for x in rows)


def test_fact_files_are_read_by_schema(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"subject_id": "a", "when_raw": "2009"}\n{"subject_id": "b"}\n')
    rows = files.fact_files(spark, str(tmp_path), "subject_id string, when_raw string").collect()
    assert sorted((x.subject_id, x.when_raw) for x in rows) == [("a", "2009"), ("b", None)]


def test_profiles_are_written_and_read_again(spark, sf_dir, tmp_path):
    from factloom.plans import catalog

    made = catalog.profile_html(spark, sf_dir)
    pages.write_profiles(made, str(tmp_path / "site"))
    again = spark.read.parquet(str(tmp_path / "site"))
    assert again.count() == made.count()
    assert again.select("file_name").distinct().count() == again.count()


def test_a_stream_counts_what_the_batch_counts(spark, sf_dir, tmp_path):
    batch = tb.table(spark, sf_dir, "events")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ev.daily(ev.read_stream(spark, str(tmp_path / "in"), batch.schema))
    running = stream.writeStream.outputMode("complete").format("memory").queryName("days").start()
    running.processAllAvailable()
    running.stop()
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, ev.daily(batch).collect()))
