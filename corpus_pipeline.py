"""The corpus pipeline: toxicity, near duplicates, substring dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of documents; run() writes each stage's rows as Parquet to the shared folder and reads
them again as the next one's docs. Stages let the session hand texts to Python in batches of 4 MB, unless it has
a setting for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import mixing, ngram_join, sentencepiece_codec, substring_dedup, toxicity
from factloom.llm.common import documents, fresh, materialise, small_batches
from factloom.llm.queries import labels, tokenizer_path

#: Stands for a null id.
LAST = (1 << 63) - 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that score 0.5 or more. The model is fitted on the labelled ones among docs.

    A row is judged by its text alone: null and empty texts have the score of no feature, very long ones are
    scored whole, equal texts go or stay together. Without labels of both classes the smoothed share of the
    labels decides for all, and with none at all (a score of one half) documents stay. Columns stay, whatever their names.
    """
    small_batches(spark)
    model = toxicity.train(docs, labels(spark, sf_dir))
    if not model.grams:
        return docs
    mark = fresh("toxicity", *docs.columns)
    return toxicity.score(docs, model, score_col=mark).where(F.col(mark) < 0.5).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, Jaccard 0.8 or more) the document with the smallest id stays.

    A document is its id and its text: rows that repeat an id with other texts are told apart, rows equal in
    both are one document, of which one row stays. Null ids come last in a group. Null and empty texts are
    no copies of each other. Columns stay, whatever their names.
    """
    own, key = fresh("own_id", *docs.columns), fresh("row_key", *docs.columns)
    first = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(LAST))
    small_batches(spark)
    found = ngram_join.link_components(docs, shingle=5, percent=80, groups=True).select(first("doc_id").alias(own), F.col("row_key").alias(key), "group")
    found = materialise(found, "near-copies")
    heads = found.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(F.struct(own, key)).alias("head")).select("head.*")
    stay = heads.unionByName(found.where(F.col("group").isNull()).select(own, key)).distinct()
    rows = docs.withColumns({own: first("doc_id"), key: ngram_join.row_key(docs, "doc_id", "text")}).dropDuplicates([own, key])
    return rows.join(stay, [own, key], "left_semi").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that an earlier document has; n_chars is that of what is left.

    Null texts stay null, a text that repeats whole becomes empty; no row goes. See substring_dedup.dedupe().
    """
    small_batches(spark)
    left = substring_dedup.dedupe(docs, spans_col=None)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (0 to 3 times).

    Rows are counted one by one, whether or not they share an id or have none: each source comes within one document of its target.
    Texts without words have size 0 and come as often as their source's documents do on average. Columns
    stay, whatever their names.
    """
    copies, copy = fresh("copies", *docs.columns), fresh("copy", *docs.columns)
    mixed = mixing.mix(docs, cap=3, carry=copies)
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).where(F.col(copies) > 0).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of ids and decoded text of each document.

    Null and empty texts have no tokens; rows are coded one by one, so repeated rows stay.
    """
    small_batches(spark)
    coded = sentencepiece_codec.round_trip(docs, tokenizer_path("piece_bpe_32k.model"), keep=("doc_id", "source"))
    return coded.select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL cannot express a fitted classifier or a merge-type tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
