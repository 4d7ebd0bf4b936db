import zlib

from frames import empty, frame, rows

from factloom.llm import queries, toxicity


def marks(spark, ids):
    return spark.createDataFrame([(k, int(k in ids)) for k in range(20)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")


def test_held_out_accuracy(spark):
    found = queries.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert len(found) > 500
    assert sum(x.predicted == x.toxic for x in found) / len(found) > 0.97
    caught = [x.predicted for x in found if x.toxic]
    assert sum(caught) / len(caught) > 0.9


def test_folds(spark):
    df = spark.range(50).select(toxicity.held_out("id" and __import__("pyspark").sql.functions.col("id")).alias("out"), "id")
    assert all(x.out == (zlib.crc32(str(x.id).encode()) % 5 == 0) for x in df.collect())


def test_awkward_rows_are_scored(spark):
    df = frame(spark)
    model = toxicity.train(df, marks(spark, {4, 5}))
    scored = toxicity.score(df, model)
    assert sorted(scored.columns) == sorted(df.columns)
    got = scored.collect()
    assert len(got) == len(rows())
    assert all(0 <= x.score <= 1 for x in got)
    assert len({x.score for x in got if x.text in (None, "")}) == 1
    assert toxicity.score(empty(spark), model).count() == 0


def test_training_without_a_class(spark):
    model = toxicity.train(frame(spark), marks(spark, set()))
    assert not model.grams
    assert {x.score for x in toxicity.score(frame(spark), model).collect()} == {toxicity.score_texts(["x"], model)[0]}


def test_model_and_scores_equal_a_plain_version(spark):
    """Counts, ratios, fit and scores from loops over texts and dense arrays."""
    import math
    import random
    import re

    import numpy as np

    rnd = random.Random(3)
    vocabulary = ["Vile", "awful", "naïve", "good", "tree", "house", "x", "kind_word", "nastily", "green", "river2"]
    table = [(k, " ".join(rnd.choice(vocabulary[:4] if k % 3 == 0 and rnd.random() < 0.4 else vocabulary[3:]) for _ in range(12)), int(k % 3 == 0)) for k in range(240)]
    df = spark.createDataFrame(table, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    train = [x for x in table if zlib.crc32(str(x[0]).encode()) % 5]
    held = lambda text, gram: any(gram in f" {w} " for w in re.findall(r"[^\W_]+", text.lower()))
    grams = sorted({f" {w} "[a : a + n] for _, t, _ in train for w in re.findall(r"[^\W_]+", t.lower()) for n in toxicity.LENGTHS for a in range(len(w) + 3 - n)})
    n = [sum(x[2] == c for x in train) for c in (0, 1)]
    chosen, ratio = [], []
    for gram in grams:
        have = [sum(held(x[1], gram) for x in train if x[2] == c) for c in (0, 1)]
        p = sum(have) / sum(n)
        error = math.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
        if sum(have) >= toxicity.LEAST_TEXTS and error > 0 and abs(have[1] / n[1] - have[0] / n[0]) >= toxicity.LEAST_Z * error:
            chosen.append(gram)
            ratio.append(math.log(((have[1] + 0.5) / (n[1] + 1)) / ((have[0] + 0.5) / (n[0] + 1))))
    x = np.array([[held(t, g) for g in chosen] for _, t, _ in train], float) * np.array(ratio)
    y = np.array([c for *_, c in train], float)
    beta, m, v = np.zeros(len(chosen) + 1), 0, 0
    wide = np.hstack([x, np.ones((len(x), 1))])
    for step in range(1, toxicity.ROUNDS + 1):
        slope = (1 / (1 + np.exp(-wide @ beta)) - y) / len(y)
        gradient = wide.T @ slope + toxicity.RIDGE * np.append(beta[:-1], 0)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        beta = beta - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = {g: b * r for g, b, r in zip(chosen, beta, ratio, strict=False) if abs(b * r) > 1e-4}
    assert set(model.grams) == set(weights)
    assert all(abs(w - weights[g]) < 1e-6 for g, w in zip(model.grams, model.weights, strict=True))
    for row in toxicity.score(df, model).collect():
        z = beta[-1] + sum(w for g, w in weights.items() if held(row.text, g))
        assert abs(row.score - 1 / (1 + math.exp(-z))) < 1e-6


def test_a_repeated_id_is_one_row_whatever_the_order(spark):
    table = [(k, f"some text {k} vile" if k % 2 else f"some text {k} good") for k in range(40)] + [(3, "good good"), (3, "zz top")]
    marks = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, toxic int")
    models = [toxicity.train(spark.createDataFrame(x, "doc_id bigint, text string").repartition(n), marks) for x, n in ((table, 1), (table[::-1], 5))]
    assert models[0].grams == models[1].grams and models[0].weights == models[1].weights
