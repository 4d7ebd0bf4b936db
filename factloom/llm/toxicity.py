"""Toxicity scores (operator 2): a linear classifier on character n-grams scaled by naive Bayes.

Features are n-grams of the words (letters and digits, lower case) of a text, taken inside words padded
with a blank, and count as present or absent. A feature's value is its log-count ratio: the logarithm of
its share of toxic texts over its share of other texts. A logistic regression on those values is fitted
by gradient descent. All n-grams are features that LEAST_TEXTS sampled texts hold and whose shares
differ by more than chance (LEAST_Z standard errors): those of an equal share have a value near zero and
would add noise alone. A word's features are found by one Aho-Corasick scan and kept, so a text costs
one look-up for each of its distinct words, whole and whatever its length.

The fit uses a bounded sample of labelled rows (PER_CLASS of each class, those with the smallest
hash of the id), weighted to the classes' true shares. Scoring covers every row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fresh, give_back, materialise, text_of, with_text

#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 4000
#: Lengths of the n-grams, blanks at a word's ends included.
LENGTHS = (3, 4, 5, 6, 7, 8)
#: Sampled texts that must hold an n-gram, and standard errors by which its shares differ at least.
LEAST_TEXTS, LEAST_Z = 3, 3.0
#: Words whose features a worker keeps, and letters of the longest such word.
WORDS_KEPT, WORD_CHARS = 100_000, 64
#: Added to each count before the ratio is taken.
SMOOTHING = 0.5
#: n-grams that a task counts before it hands the counts on, and values of features that the fit holds at once, about.
GRAMS_HELD, VALUES_HELD = 200_000, 500_000
#: Bytes of rows whose texts are Python strings at once, about.
SLICE_BYTES = 4 << 20
#: Tasks that the sample's texts are dealt to.
SAMPLE_TASKS = 24
RIDGE, RATE, ROUNDS = 1e-4, 0.05, 300

FIND_WORDS = re.compile(r"[^\W_]+").findall


class Model:
    """n-grams with their weights, and the bias."""

    def __init__(self, grams: list[str], weights: list[float], bias: float):
        self.grams, self.weights, self.bias = tuple(grams), tuple(weights), bias


def words_of(text: str) -> set[str]:
    return set(FIND_WORDS(text.lower()))


def word_grams(word: str) -> set[str]:
    padded = f" {word} "
    return {padded[k : k + n] for n in LENGTHS for k in range(len(padded) - n + 1)}


def text_grams(text: str) -> set[str]:
    return {gram for word in words_of(text) for gram in word_grams(word)}


class Features(dict):
    """The numbers of the features that each word holds; those of frequent words are kept."""

    def __init__(self, grams: Iterable[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, gram in enumerate(grams):
            self.automaton.add_word(gram, k)
        if len(self.automaton):
            self.automaton.make_automaton()

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple({k for _, k in self.automaton.iter(f" {word} ")}) if len(self.automaton) else ()
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = found
        return found

    def of(self, text: str) -> set[int]:
        return set().union(*map(self.__getitem__, words_of(text)))


def held_out(id_column: Column) -> Column:
    """Rows kept from training: those whose id's CRC-32, as text, is a multiple of 5. Null ids are not."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(False))


def _gram_counts(batches):
    """Rows of n-grams with the texts of each class that hold them; an n-gram may come several times, each with a part of its count."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def handed_on() -> pa.RecordBatch:
        grams = list(counts[0] | counts[1])
        columns = [pa.array(grams, pa.string()), *(pa.array([counts[k][x] for x in grams], pa.int64()) for k in (1, 0))]
        for x in counts:
            x.clear()
        return pa.RecordBatch.from_arrays(columns, names=["gram", "toxic", "other"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update(text_grams(text))
            if len(counts[0]) + len(counts[1]) >= GRAMS_HELD:
                yield handed_on()
    yield handed_on()


def _indexed(grams: tuple[str, ...]):
    def run(batches):
        features = Features(grams)
        for batch in batches:
            found = [sorted(features.of(text)) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["features", "toxic"])

    return run


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str, text_col: str) -> DataFrame:
    """text and toxic of up to per_class labelled training rows of each class."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marks = marks.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for k in (0, 1)]
    # at most 2 * per_class ids, whatever the size of the tables
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("text")).join(picked, "__id")
    return rows.groupBy("__id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def fit(row: np.ndarray, column: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients of a ridge logistic regression on the scaled features, by Adam; text row[k] holds feature column[k], in order of texts."""
    n = len(toxic)
    first = np.searchsorted(row, np.arange(n + 1))  # where each text's features begin
    cuts = [0]  # whole texts whose features are held at once
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first, first[cuts[-1]] + VALUES_HELD, side="right")) - 1))
    beta, bias = np.zeros(len(ratio)), 0.0
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    share = weight / weight.sum()
    for step in range(1, ROUNDS + 1):
        by_feature, by_text = np.zeros(len(ratio)), 0.0
        scaled = ratio * beta
        for start, stop in pairwise(cuts):
            held, sizes = column[first[start] : first[stop]], np.diff(first[start : stop + 1])
            z, some = np.full(stop - start, bias), np.flatnonzero(sizes)
            if len(some):
                z[some] += np.add.reduceat(scaled[held], (first[start:stop] - first[start])[some])
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[start:stop]) * share[start:stop]
            by_feature += np.bincount(held, np.repeat(slope, sizes), len(ratio))
            by_text += slope.sum()
        gradient = np.append(by_feature * ratio + RIDGE * beta, by_text)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        beta, bias = beta - move[:-1], bias - move[-1]
    return beta, float(bias)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits a model on the labelled rows that held_out() leaves.

    Null labels and ids are left out; of a repeated id the row with the smallest text is used, and the higher label. With no
    row of either class the model knows no feature and scores every text by the smoothed class share.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    shares = {row.toxic: row.n for row in marked.groupBy(F.col(label_col).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    rows = materialise(sample(docs, labels, label_col, per_class, id_col, text_col), "labelled-sample").repartition(SAMPLE_TASKS)
    sampled = {row.toxic: row.n for row in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    have = [sampled.get(k, 0) for k in (0, 1)]
    if not all(have):
        return Model([], [], float(np.log((shares.get(1, 0) + SMOOTHING) / (shares.get(0, 0) + SMOOTHING))))
    counts = rows.mapInArrow(_gram_counts, "gram string, toxic bigint, other bigint").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    in_toxic = (F.col("toxic") + SMOOTHING) / (have[1] + 2 * SMOOTHING)
    in_other = (F.col("other") + SMOOTHING) / (have[0] + 2 * SMOOTHING)
    both = (F.col("toxic") + F.col("other")) / sum(have)
    error = F.sqrt(both * (1 - both) * (1 / have[0] + 1 / have[1]))
    told = F.abs(F.col("toxic") / have[1] - F.col("other") / have[0]) >= LEAST_Z * error
    best = counts.where((F.col("toxic") + F.col("other") >= LEAST_TEXTS) & (error > 0) & told)
    best = best.select("gram", F.log(in_toxic / in_other).alias("ratio")).orderBy("gram").collect()  # bounded by the sample
    grams = tuple(x.gram for x in best)
    table = rows.mapInArrow(_indexed(grams), "features array<int>, toxic int").toArrow().combine_chunks()  # bounded by the sample
    lists = table.column("features").combine_chunks()
    row = np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy()))
    toxic = table.column("toxic").to_numpy()
    weight = np.where(toxic == 1, shares[1] / have[1], shares[0] / have[0])
    scale = np.array([x.ratio for x in best])
    beta, bias = fit(row, lists.flatten().to_numpy(), toxic, weight, scale)
    keep = np.flatnonzero(np.abs(beta * scale) > 1e-4)
    return Model([grams[k] for k in keep], [float(beta[k] * scale[k]) for k in keep], bias)


@lru_cache(maxsize=1)
def _features(grams: tuple[str, ...]) -> Features:
    return Features(grams)


def score_texts(texts: Iterable[str], model: Model) -> np.ndarray:
    weight, features = model.weights.__getitem__, _features(model.grams)
    z = np.array([model.bias + math.fsum(map(weight, features.of(x))) for x in texts], dtype=float)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep) with the probability that each row's whole text is toxic.

    Null and empty texts hold no feature and get the bias's score. Rows are scored one by one, by the
    text alone: equal texts have equal scores, repeated rows stay, an empty table stays empty, and a
    column already named score_col is replaced.
    """
    with_text(df, text_col)
    kept = [c for c in (df.columns if keep is None else keep) if c != score_col]
    whole = fresh("whole_text", *kept, score_col)
    rows = df.select(*(F.col(c) for c in kept), text_of(text_col).alias(whole))
    schema = rows.drop(whole).withColumn(score_col, F.lit(0.0)).schema

    def run(batches):
        for whole_batch in batches:
            n = whole_batch.num_columns - 1
            step = max(1, whole_batch.num_rows * SLICE_BYTES // max(1, whole_batch.nbytes))
            for start in range(0, whole_batch.num_rows, step):
                batch = whole_batch.slice(start, step)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(score_texts(batch.column(n).to_pylist(), model), pa.float64())], names=[*kept, score_col])
        _features.cache_clear()  # a worker that waits for its next task holds no memory that others need
        give_back()

    return rows.mapInArrow(run, schema)
