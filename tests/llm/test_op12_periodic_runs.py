import hashlib
import random
import zlib

import numpy as np
import pytest
from frames import empty, frame, rows
from pyspark.sql import functions as F

from factloom.llm import periodic_runs, queries
from factloom.llm.common import WORD


def words_of(text):
    import re

    return re.findall(WORD, text or "")


def plain_runs(words, min_words=6, min_times=4):
    """Runs by their definition: every period, every stretch, smallest period checked word by word."""
    n, out = len(words), []
    for q in range(1, n // min_times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(min_words, min_times * q) and not any(stretch[:-r] == stretch[r:] for r in range(1, q)):
                out.append((i, len(stretch), q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_left(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def loopy(rnd):
    letters = "abcd"[: rnd.randrange(1, 5)]
    words = [rnd.choice(letters) for _ in range(rnd.randrange(0, 60))]
    for _ in range(rnd.randrange(3)):
        block = [rnd.choice(letters) for _ in range(rnd.randrange(1, 9))]
        at = rnd.randrange(len(words) + 1)
        words[at:at] = block * rnd.randrange(2, 9)
    return words


def test_many_texts_at_once_equal_the_plain_search():
    rnd = random.Random(3)
    for _ in range(800):
        texts = [loopy(rnd) for _ in range(rnd.randrange(1, 6))]
        min_times = rnd.choice([4, 4, 5, 7])
        runs, left = periodic_runs._collapsed([" ".join(x).encode() for x in texts], 6, min_times)
        for words, got, kept in zip(texts, runs, left, strict=True):
            assert got == plain_runs(words, 6, min_times)
            assert kept.decode() == plain_left(words, got)


def test_names_are_equal_where_stretches_are():
    rnd = random.Random(4)
    letters = [rnd.randrange(2) for _ in range(300)] + list(range(2, 40))
    first = {}
    levels = periodic_runs.name_levels(np.array([first.setdefault(x, k) for k, x in enumerate(letters)]))
    for k, level in enumerate(levels):
        for i in range(0, len(letters), 7):
            for j in range(i + 1, len(letters), 5):
                if level[i] >= 0 and level[j] >= 0:
                    assert (level[i] == level[j]) == (letters[i : i + 2**k] == letters[j : j + 2**k])
                elif len(letters) - j >= 2**k:
                    assert letters[i : i + 2**k] != letters[j : j + 2**k]


def test_long_loops_keep_one_period():
    block = " ".join(str(k) for k in range(1000))
    runs, left = periodic_runs._collapsed([b"to " * 50_000, (block + " ").encode() * 7, b""], 6, 4)
    assert runs == [[(0, 50_000, 1)], [(0, 7000, 1000)], []]
    assert left == [b"to", block.encode(), b""]


@pytest.mark.parametrize("part_bytes", [1, 3000, 1 << 21])
def test_parts_change_nothing(monkeypatch, part_bytes):
    monkeypatch.setattr(periodic_runs, "PART_BYTES", part_bytes)
    sizes = [0, 10, 5000, 0, 2999, 1, 1]
    ends = periodic_runs._parts(sizes)
    assert ends[-1] == len(sizes) and ends == sorted(set(ends))
    for begin, end in zip([0, *ends], ends, strict=False):
        assert sum(x > 0 for x in sizes[begin:end]) <= 1 or sum(sizes[begin:end]) <= part_bytes
    assert periodic_runs._parts([]) == []
    assert periodic_runs._collapsed([], 6, 4) == ([], [])


def test_frames_with_nulls_repeats_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PART_BYTES", 2000)
    df = frame(spark).withColumns({"runs": F.lit("old"), "text_to_collapse": F.lit(1), "Collapsed": F.lit("old")})
    found = periodic_runs.collapse(df)
    assert set(found.columns) == set(df.columns) - {"Collapsed"} | {"collapsed"}
    out = found.collect()
    assert len(out) == len(rows())
    for x in out:
        runs = [tuple(r) for r in x.runs]
        assert runs == plain_runs(words_of(x.text))
        assert x.collapsed == plain_left(words_of(x.text), runs)
    assert any(x.runs for x in out)
    assert periodic_runs.collapse(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="four periods"):
        periodic_runs.collapse(df, min_times=3)


def expected(doc_id, text):
    words = words_of(text)
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
    shown = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(plain_left(words, runs)))


def test_query_equals_the_contract(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_periodic_runs(spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(*x) for x in docs)
    frame(spark, [(k, "a b c d e " * (k % 7), *x[2:]) for k, x in enumerate(rows() * 3)] + rows()[7:11] + rows()[-4:-3]).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr) == sorted((expected(*x) for x in docs), key=repr)
