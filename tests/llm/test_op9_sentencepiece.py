import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece
from frames import empty, frame, rows

from factloom.llm import queries
from factloom.llm import sentencepiece_codec as sc

PATH = queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts_equal_the_library(library):
    own, rnd = sc.codec(PATH), random.Random(7)
    pieces = [x.replace("▁", " ") for x in own.ids]
    letters = "aab bc  the  \n\t.,'1 23é漢字▁😀ﬁ²AT\x01   <s>"
    for k in range(8000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) if k % 2 else "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 7)))
        ids = library.encode(text)
        assert own.encode(text).tolist() == ids, text
        assert own.decode(ids) == library.decode(ids), text


def test_random_ids_are_decoded_as_by_the_library(library):
    own, rnd = sc.codec(PATH), random.Random(8)
    for k in range(4000):
        ids = [rnd.randrange(3, 259) if k % 2 else rnd.randrange(32000) for _ in range(rnd.randrange(8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(sc, "SEGMENT_CACHE", 3)
    monkeypatch.setattr(sc, "PAIR_CACHE", 3)
    monkeypatch.setattr(sc, "KEY_CHARS", 5)
    own = sc.PieceCodec(PATH)
    text = rows()[4][1]
    assert own.encode(text).tolist() == library.encode(text)


def test_query_equals_the_library(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for x in queries.op9_sentencepiece(spark, sf_dir).collect():
        ids = library.encode(texts[x.doc_id])
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_awkward_rows(spark, library):
    coded = sc.decode(sc.encode(frame(spark), PATH), PATH)
    assert coded.columns == [*frame(spark).columns, "ids", "decoded"]
    got = coded.collect()
    assert len(got) == len(rows())
    assert all(x.ids == library.encode(x.text or "") and x.decoded == library.decode(x.ids) for x in got)
    assert sc.round_trip(empty(spark), PATH).count() == 0
    assert sorted((repr(x.doc_id), x.decoded) for x in sc.round_trip(frame(spark), PATH).collect()) == sorted((repr(x.doc_id), x.decoded) for x in got)


def test_columns_with_names_of_the_operator_stay(spark):
    df = frame(spark, rows()[:4]).selectExpr("doc_id", "text", "doc_id AS __text", "doc_id AS text_to_code")
    got = sc.round_trip(df, queries.tokenizer_path("piece_bpe_32k.model"), keep=("doc_id", "__text", "text_to_code"))
    assert got.columns == ["doc_id", "__text", "text_to_code", "ids", "decoded"]
    assert all(x.doc_id == x["__text"] == x.text_to_code for x in got.collect())


def test_lists_are_decoded_together(library, monkeypatch):
    own, rnd = sc.codec(PATH), random.Random(9)
    lists = [[rnd.choice((rnd.randrange(3), rnd.randrange(3, 259), rnd.randrange(32000), rnd.randrange(259, 32000))) for _ in range(rnd.randrange(7))] for _ in range(4000)]
    lists += [library.encode(x) for x in ("", " ", "a", " a  b ", "é漢字😀 x", "\n\n")]
    column = pa.array([None, *lists, None, []], pa.list_(pa.int32()))
    want = ["", *map(library.decode, lists), "", ""]
    for start, length in ((0, len(want)), (3, 500), (len(want) - 2, 2), (0, 0)):  # slices have offsets of their own
        assert sc._decode_column(own, column.slice(start, length)).to_pylist() == want[start : start + length]

    called = []
    monkeypatch.setattr(sc.PieceCodec, "decode", lambda self, ids: called.append(ids))
    plain = [x for x in (library.encode(f"word {k} of plain text\nand a second line") for k in range(100))]
    got = sc._decode_column(own, pa.array(plain, pa.list_(pa.int32()))).to_pylist()
    assert got == [library.decode(x) for x in plain] and not called
