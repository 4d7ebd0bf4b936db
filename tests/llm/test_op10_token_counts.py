import random

import pytest
import sentencepiece
from frames import empty, frame, rows
from tokenizers import Tokenizer

from factloom.llm import queries
from factloom.llm import token_counts as tc
from factloom.llm.common import shared_folder

PATH = queries.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts_equal_the_library(library):
    own, rnd = tc.ByteLevelCounter(PATH), random.Random(9)
    assert own.quick
    letters = list("aab bc  the  \n\t\r.,'1 23é漢字😀ﬁ²AT\x01\x1c\x85\xa0  ǅͅ٣") + ["'s", "'ll", "<|endoftext|>", "<|endof", "  "]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(6000)]
    expected = [len(x) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert own.counts(texts) == expected
    assert tc.ByteLevelCounter(PATH).counts(texts[:50] + texts[:50]) == expected[:50] * 2


def test_full_piece_cache(library, monkeypatch):
    monkeypatch.setattr(tc, "PIECE_CACHE", 10)
    monkeypatch.setattr(tc, "SLICE_CHARS", 50)
    texts = [x[1] or "" for x in rows()]
    assert tc.ByteLevelCounter(PATH).counts(texts) == [len(x) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_cache_holds_each_text_once(spark, library):
    folder = shared_folder(spark, "test-cache")
    few = tc.count_tokens(frame(spark, rows()[:6]), PATH, folder).collect()
    assert len(few) == 6
    got = tc.count_tokens(frame(spark), PATH, folder).collect()
    assert len(got) == len(rows())
    text = {x[0]: x[1] or "" for x in rows() if x[0] not in (None, 5)}
    for x in got:
        if x.doc_id in text:
            assert (x.n_bytes, x.n_tokens) == (len(text[x.doc_id].encode()), len(library.encode(text[x.doc_id], add_special_tokens=False)))
    stored = spark.read.parquet(folder)
    assert stored.count() == stored.select("digest").distinct().count() == len({x[1] or "" for x in rows()})
    assert [x.version for x in stored.select("version").distinct().collect()] == [tc.version_digest(PATH)]
    assert tc.count_tokens(empty(spark), PATH, folder).count() == 0
    assert spark.read.parquet(folder).count() == stored.count()


def test_cached_counts_are_used(spark):
    folder = shared_folder(spark, "test-cache")
    df = spark.createDataFrame([(1, "some text")], "doc_id int, text string")
    tc.count_tokens(df, PATH, folder).collect()
    (run,) = tc._runs(spark, f"{folder}/version={tc.version_digest(PATH)}")
    stored = spark.read.parquet(run).selectExpr("digest", "cast(77 as bigint) n_tokens").collect()
    spark.createDataFrame(stored, "digest binary, n_tokens bigint").write.mode("overwrite").parquet(run)
    assert tc.count_tokens(df, PATH, folder).first().n_tokens == 77


def test_sentencepiece_models_count_too(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {x.doc_id: x.n_tokens for x in tc.count_tokens(frame(spark, rows()[:15]), path, shared_folder(spark, "test-cache")).collect()}
    assert got == {x[0]: len(model.encode(x[1] or "")) for x in rows()[:15]}


def test_runs_that_share_a_cache_at_one_time_lose_nothing(spark, library):
    from concurrent.futures import ThreadPoolExecutor

    folder = shared_folder(spark, "test-cache")
    tables = [spark.createDataFrame([(k, f"text number {k % 200} of {n % 2}") for k in range(400)], "doc_id int, text string") for n in range(6)]
    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(lambda df: tc.count_tokens(df, PATH, folder).collect(), tables))
    for n, got in enumerate(found):
        assert len(got) == 400
        assert all(x.n_tokens == len(library.encode(f"text number {x.doc_id % 200} of {n % 2}")) for x in got)
    assert len(tc._runs(spark, f"{folder}/version={tc.version_digest(PATH)}")) == 6


def test_a_missing_count_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(tc, "_stored", lambda spark, runs: spark.createDataFrame([], "digest binary, n_tokens bigint"))
    with pytest.raises(Exception, match="no count"):
        tc.count_tokens(frame(spark), PATH, shared_folder(spark, "test-cache")).collect()
