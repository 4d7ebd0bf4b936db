"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, digest string, token bigint, bucket string, __extra string"


def rows():
    rnd = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    prose = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", "", ",", ".\n"]) + str(rnd.randrange(40)) for _ in range(n))
    base, passage, long = prose(120), prose(90), prose(6000)
    texts = [base, base, base.replace("alpha", "Alpha", 1), base + " one more word", prose(80), prose(80) + "\n" + passage, passage + "\n" + prose(70), None, "", "", " ", "one", "one two", "Ünï çödé 漢字 😀 ﬁ", long, long + " tail", "To " * 300, prose(30), "x" * 5000]
    out = [(k, t, "en", f"src{k % 3}", None if t is None else len(t), 0.5, "d", 1, "b", "e") for k, t in enumerate(texts)]
    out.append((100, None, None, None, None, None, None, None, None, None))
    out.append((None, base, None, None, 1, None, None, None, None, None))
    out.append((None, "no id at all", None, "src1", 1, None, None, None, None, None))
    out.append((4, texts[4], "en", "src1", 3, 0.5, "d", 1, "b", "e"))
    out.append((4, texts[4], "en", "src1", 3, 0.5, "d", 1, "b", "e"))
    out.append((5, "another text of the same id", "en", "src2", 3, 0.5, "d", 1, "b", "e"))
    return out


def frame(spark, some=None, parts=3):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
