import random
from collections import Counter

import corpus_pipeline as cp
import sentencepiece
from frames import empty, frame, rows
from pyspark.sql import functions as F

from factloom.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    counts = []
    for _, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.dtypes == docs.dtypes
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        counts.append(kept.count())
    assert counts[0] >= counts[1] == counts[2] > 0
    out = cp.encode(spark, kept, SF).collect()
    assert len(out) == counts[3]
    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    sizes = {x.doc_id: len(model.encode(x.text or "")) for x in kept.collect()}
    assert all(x.n_tokens == sizes[x.doc_id] for x in out)


def test_toxic_documents_go(spark):
    docs, marks = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    left = {x.doc_id for x in cp.drop_toxic(spark, docs, "/root/testdata/sf0.1").select("doc_id").collect()}
    held = marks.where(toxicity.held_out(F.col("doc_id"))).collect()
    assert sum((x.doc_id in left) != bool(x.toxic) for x in held) / len(held) > 0.97


def test_one_of_each_group_stays(spark):
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(900)}" for _ in range(200)]
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(5, 50, 5)]
    table = [(k, x, "en", "s", len(x or "")) for k, x in enumerate([*near, *near[:2], "quite another text", "", None])]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(x.doc_id for x in cp.drop_near_copies(spark, docs, SF).collect()) == [0, len(near) + 2, len(near) + 3, len(near) + 4]


def test_rows_that_share_an_id_are_told_apart(spark):
    rnd = random.Random(12)
    a, b, c = (" ".join(f"w{rnd.randrange(900)}" for _ in range(100)) for _ in range(3))
    table = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, c), (5, c), (None, b), (None, "alone here")]
    docs = spark.createDataFrame([(k, x, "en", "s", len(x)) for k, x in table], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert Counter((x.doc_id, x.text) for x in cp.drop_near_copies(spark, docs, SF).collect()) == Counter([(1, a), (2, b), (3, c), (None, "alone here")])


def test_columns_of_any_name_pass_through(spark):
    names = ("shard", "tier", "version", "__id", "__text", "__places", "__copies", "__run", "own_id", "row_key", "toxicity", "copies", "copy", "whole_text", "group", "digest", "places", "Found")
    df = frame(spark).withColumns({x: F.concat(F.lit(x), F.coalesce(F.col("doc_id"), F.lit(-1))) for x in names})
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        assert all(x[n] == f"{n}{-1 if x.doc_id is None else x.doc_id}" for x in out.collect() for n in names)


def test_stages_on_awkward_rows(spark):
    df, ids = frame(spark), Counter(x[0] for x in rows())
    for stage in (cp.drop_toxic, cp.drop_near_copies, cp.cut_repeats, cp.mix):
        for table in (df, empty(spark)):
            assert stage(spark, table, SF).columns == df.columns
    near = Counter((x.doc_id, x.text) for x in cp.drop_near_copies(spark, df, SF).collect())
    assert max(near.values()) == 1 and (5, "another text of the same id") in near and (None, "no id at all") in near
    assert Counter(x.doc_id for x in cp.cut_repeats(spark, df, SF).collect()) == ids
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in cp.cut_repeats(spark, df, SF).collect())
    assert Counter(x.doc_id for x in cp.encode(spark, df, SF).collect()) == ids
    assert all(n <= 3 * ids[k] for k, n in Counter(x.doc_id for x in cp.mix(spark, df, SF).collect()).items())
    assert cp.mix(spark, df, SF).dtypes == df.dtypes
    assert cp.encode(spark, empty(spark), SF).count() == 0


def test_mix_keeps_to_its_targets_without_ids_and_with_repeated_ones(spark):
    rnd = random.Random(21)
    for ids in (lambda k: None, lambda k: k % 7, lambda k: k):
        table = [(ids(k), " ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(10, 60))), "en", f"s{k % 3}", 0) for k in range(900)]
        docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        words, largest = Counter(), Counter()
        for _, text, _, source, _ in table:
            words[source] += len(text.split())
            largest[source] = max(largest[source], len(text.split()))
        taken, times = Counter(), Counter()
        for x in cp.mix(spark, docs, SF).collect():
            taken[x.source] += len(x.text.split())
            times[x.text] += 1
        total, weights = sum(words.values()), {"s0": 1, "s1": 2, "s2": 3}
        assert all(abs(taken[s] - total * w / 6) <= 2 * largest[s] for s, w in weights.items()), taken
        assert max(times.values()) <= 3


def test_run_is_registered():
    import __spark_entry__ as entry

    assert {"pipeline", *(x for x in queries.QUERIES)} <= entry.queries().keys()
