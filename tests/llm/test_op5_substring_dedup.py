import random
import re

import numpy as np
from frames import empty, frame, rows
from pyspark.sql import functions as F

from factloom.llm import substring_dedup as sd


def test_gear_hashes_by_doubling_equal_the_rolling_sum():
    data = random.Random(1).randbytes(300)
    h, plain = 0, []
    for byte in data:
        h = ((h << 1) + int(sd.GEAR[byte])) & 0xFFFFFFFF
        plain.append(h)
    assert sd.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == plain


def test_chunks_cover_the_text_and_resist_insertions(monkeypatch):
    data = random.Random(2).randbytes(20_000)
    whole = sd.cut_places(data)
    assert whole[-1] == len(data)
    sizes = np.diff([0, *whole])
    assert sizes.max() <= sd.MAX_BYTES
    assert sizes[:-1].min() >= sd.MIN_BYTES
    cuts = lambda x: {x[a:b] for a, b in zip([0, *sd.cut_places(x)], sd.cut_places(x), strict=False)}
    moved = cuts(data[:5000] + b"inserted" + data[5000:])
    assert len(cuts(data) - moved) < 12
    monkeypatch.setattr(sd, "BLOCK", 1000)
    assert sd.cut_places(data) == whole
    assert sd.cut_places(b"") == []


def plain_windows(data, least):
    """Windows by trying all stretches of chunks."""
    marks = [0, *sd.cut_places(data)]
    words = lambda i, j: len(re.findall(rb"[^\x20\x09-\x0D]+", data[marks[i] : marks[j]]))
    n = len(marks)
    forward = {i: next((j for j in range(i + 1, n) if words(i, j) >= least), None) for i in range(n - 1)}
    found = {(i, j) for i, j in forward.items() if j}
    for j in set(range(1, n)) - set(forward.values()):
        i = next((i for i in range(j - 1, -1, -1) if words(i, j) >= least), None)
        if i is not None:
            found.add((i, j))
    return [(marks[i], marks[j]) for i, j in sorted(found)]


def test_windows_equal_the_plain_ones():
    rnd = random.Random(9)
    for least in (1, 3, 20):
        for n in (0, 1, 5, 60, 200):
            text = " ".join("".join(rnd.choice("abcd") for _ in range(rnd.choice([1, 4, 9, 90]))) for _ in range(n)) + rnd.choice(["", " ", "\n"])
            assert sd.windows(text.encode(), least) == plain_windows(text.encode(), least)


def brute(table, least):
    """Cuts of documents one by one, from the texts of the windows themselves."""
    first: dict = {}
    found = {}
    for own, text in table:
        data = (text or "").encode()
        found[own, text] = [(a, b, data[a:b]) for a, b in plain_windows(data, least)]
        for _, _, x in found[own, text]:
            first[x] = min(first.get(x, own), own)
    out = {}
    for (own, text), parts in found.items():
        ended: dict = {}
        again = [(a, b, first[x]) for a, b, x in parts if ended.setdefault(x, b) <= a or first[x] < own]
        out[own, text] = sd.cut(text, sd.runs_of(again)) if text else (text, [])
    return out


def test_each_cut_stands_in_one_piece_elsewhere(spark):
    """Whatever is cut, each window of it is in an earlier text or before it in its own."""
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    words = {k: f" {' '.join(x.split())} " for k, x in docs.items()}
    got = sd.dedupe(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    cuts = [(x.doc_id, s.start, s.end) for x in got for s in x.cut_spans]
    assert len(cuts) > 300
    for own, start, end in cuts:
        piece = docs[own][start:end].split()[:17]  # whole words, fewer than a window has
        text = f" {' '.join(piece)} "
        assert any(text in x for k, x in words.items() if k < own) or words[own].count(text) > 1, (own, start)


def test_matches_a_plain_version(spark):
    least = -(1 << 63)
    table = {(least if x[0] is None else x[0], x[1]) for x in rows()}
    expected = brute(table, 20)
    got = sd.dedupe(frame(spark)).collect()
    assert len(got) == len(rows())
    left = {(x.doc_id, x.text, tuple((s.start, s.end, least if s.first is None else s.first) for s in x.cut_spans)) for x in got}
    assert left == {(None if own == least else own, text, tuple(gone)) for (own, _), (text, gone) in expected.items()}


def test_long_passages_are_cut_and_clean_texts_are_not(spark):
    rnd = random.Random(6)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    passages = [prose(60) for _ in range(10)]
    line = prose(10)
    table = [(k, f"{prose(50)} {line} {prose(50)}") for k in range(40)]
    table += [(100 + k, f"{prose(40)} {passages[k % 10]} {prose(40)}") for k in range(40)]
    got = {x.doc_id: x for x in sd.dedupe(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
    assert all(got[k].text == dict(table)[k] for k in range(40))
    assert all(not got[100 + k].cut_spans for k in range(10))
    later = [got[100 + k] for k in range(10, 40)]
    assert sum(bool(x.cut_spans) for x in later) >= 29
    assert all(s.first == 100 + (x.doc_id - 100) % 10 for x in later for s in x.cut_spans)
    assert sum(s.end - s.start for x in later for s in x.cut_spans) > 0.5 * sum(len(passages[k % 10]) for k in range(10, 40))


def test_whole_characters_and_empty_tables(spark):
    text = "漢字" * 400
    got = {x.doc_id: x.text for x in sd.dedupe(spark.createDataFrame([(1, text), (2, text)], "doc_id int, text string"), least_words=1).collect()}
    assert got[2] == ""
    assert set(got[1]) <= {"漢", "字"}
    assert sd.dedupe(empty(spark)).count() == 0
    assert sd.dedupe(frame(spark), spans_col=None).columns == frame(spark).columns


def test_no_passage_of_51_words_is_missed(spark):
    rnd = random.Random(7)
    prose = lambda n, most: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(1, most + 1))) for _ in range(n))
    table, n = [], 0
    for most in (1, 2, 4, 9):
        for _ in range(200):
            passage = prose(51, most)
            table += [(n, f"{prose(40, most)} {passage} {prose(40, most)}"), (10_000 + n, f"{prose(30, most)} {passage} {prose(50, most)}")]
            n += 1
    got = {x.doc_id: x.cut_spans for x in sd.dedupe(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
    assert [k for k in range(n) if not got[10_000 + k]] == []


def test_cuts_depend_on_the_sixteen_bytes_before_them():
    rnd = random.Random(13)
    for most in (1, 3, 9):
        passage = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, most + 1))) for _ in range(51)).encode()
        cuts = []
        for lead in (b"", b"x ", rnd.randbytes(5000) + b" "):
            places = [x - len(lead) for x in sd.cut_places(lead + passage + b" tail" * 40)]
            cuts.append([x for x in places if len(passage[:x].split()) > sd.WINDOW + 7 and 0 < x < len(passage) - 1 and len(passage[x:].split()) > sd.WINDOW])
        assert cuts[0] == cuts[1] == cuts[2]


def prose_of(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def test_rows_without_ids_and_of_one_id_are_held_against_each_other(spark):
    passage = prose_of(1, 80)
    for own in (None, 7):
        table = [(own, f"{passage} {prose_of(k, 30)}") for k in range(2, 5)] + [(own, prose_of(9, 60))]
        got = sd.dedupe(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
        assert sorted(len(x.cut_spans) for x in got) == [0, 0, 1, 1]
        assert sum(passage[300:400] in x.text for x in got) == 1
        assert [x.text for x in got if x.text == table[3][1]]


def test_a_text_that_repeats_nothing_is_left_alone_whatever_its_short_hash(spark, monkeypatch):
    """One id, two texts that even agree in the version that they are ordered by."""
    monkeypatch.setattr(sd, "keyed", lambda df, a, b: [F.coalesce(F.col(a).cast("long"), F.lit(sd.LEAST)), F.lit(1).cast("long")])
    passage, clean = prose_of(1, 80), prose_of(2, 120)
    table = [(1, passage), (7, f"{prose_of(3, 40)} {passage}"), (7, clean)]
    got = {x.text for x in sd.dedupe(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
    assert clean in got and passage in got


def test_the_query_has_rows_for_each_document(spark):
    from factloom.llm.queries import op5_substring_dedup

    ids = [x.doc_id for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = op5_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {x.doc_id for x in got} == set(ids)
    uncut = [x for x in got if x.start_char is None]
    assert all(x.end_char is None and x.kept_in_doc_id is None for x in uncut)
    assert len({x.doc_id for x in uncut}) == len(uncut)  # one row for each
