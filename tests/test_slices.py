import os
from urllib.parse import urlparse

import pytest
from oracle import same
from pyspark.sql import functions as F

from factloom import staging
from factloom.operators import ranking
from factloom.plans import catalog
from factloom.sources import files


@pytest.fixture
def sliced(monkeypatch):
    monkeypatch.setattr(staging, "SLICE_ROWS", 10_000)


def folders(spark):
    base = urlparse(spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")).path
    base = base if os.path.isdir(f"{base}/factloom") else os.path.dirname(base)
    return {f"{d}/{x}" for d, names, _ in os.walk(base) for x in names if os.path.basename(d) == "factloom"}


def bytes_of(folder):
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(folder) for x in names)


@pytest.mark.parametrize("name", ["neighbour_bar", "facts_numbered", "page_sources", "profile_html", "profile_parts"])
def test_slices_give_the_same_and_keep_their_result_only(spark, sf_dir, sliced, name):
    before = folders(spark)
    made = catalog.QUERIES[name](spark, sf_dir)
    kept = {x for x in folders(spark) - before if any(f.startswith("part-") for _, _, names in os.walk(x) for f in names)}
    assert len(kept) == 1  # all others were deleted, slice by slice
    same(made, sf_dir, catalog.ORACLES[name])


def test_profiles_have_one_row_for_a_page_however_long(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog.pages.profiles, "__defaults__", (5, None))
    made = catalog.profile_html(spark, sf_dir)
    assert made.groupBy("entity_id").count().where("count > 1").isEmpty()


def test_fact_files_are_written_compressed(spark, sf_dir):
    before = folders(spark)
    catalog.facts_from_files(spark, sf_dir)
    (folder,) = folders(spark) - before
    raw = files.fact_files(spark, f"file://{folder}", catalog.tb.facts(spark, sf_dir).schema).select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    assert bytes_of(folder) < raw / 4


def test_dense_numbers_of_hubs_equal_those_of_other_pages(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 7, "hub").otherwise("a").alias("page"), (F.col("id") * 7919 % 311).alias("name"), "id")
    plain, cut = (ranking.ranked(df, ["page"], ["name"], hub_rows=n, dense=True) for n in (None, 100))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))
    assert plain.where("page = 'hub'").agg(F.max("position")).first()[0] == df.where("page = 'hub'").select("name").distinct().count()
