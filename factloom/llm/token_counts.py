"""Token counts through a digest cache (operator 10).

The cache is a Parquet dataset: one folder for each tokenizer version (a digest of the vocabulary
file and of the counting settings), in it the SHA-256 of a text and its number of tokens. Texts are
joined to it by digest; only distinct texts that it lacks are encoded, and their counts are appended. Each
run appends a folder of its own, so runs that share a cache at one time do not touch each other's files. Counts are exact,
so two runs that append the same text do no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import hadoop_path, materialise, path_exists, text_of, with_text

#: How the folder of a run's counts begins.
RUN = "run="
#: Entries of each worker's cache of pre-token counts; a full cache is emptied.
PIECE_CACHE = 1_000_000
#: Characters of text that are split into pre-tokens at once.
SLICE_CHARS = 2_000_000
#: The pattern by which byte-level BPE splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes have long been settled. A text with any other one is encoded by the
#: library as a whole, as two regular expression engines may know different Unicode versions.
SETTLED = r"[\t\n\r -~\xa0-ɏΑ-ΡΣ-ώЀ-џ‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥]*"


class ByteLevelCounter:
    """Counts the tokens of byte-level BPE by counting each distinct pre-token once."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        plain = all(not (x.lstrip or x.rstrip or x.single_word) for x in self.tokenizer.get_added_tokens_decoder().values())
        shape = repr(self.tokenizer.pre_tokenizer)
        self.quick = plain and self.tokenizer.normalizer is None and "ByteLevel(add_prefix_space=False" in shape and "use_regex=True" in shape
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = regex.compile(SPLIT).findall
        self.settled = regex.compile(SETTLED).fullmatch
        self.known: dict[str, int] = {}

    def _library(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        slow = [k for k, x in enumerate(texts) if not (self.quick and self.settled(x))]
        for k in slow:
            out[k] = self._library([texts[k]])[0]
        rest = set(range(len(texts))).difference(slow)
        pieces: list[tuple[int, list[str]]] = []
        size = 0
        for k in sorted(rest):
            parts = self.added.split(texts[k]) if self.added else [texts[k]]
            out[k] = len(parts) - 1
            pieces += [(k, self.split(x)) for x in parts if x]
            size += len(texts[k])
            if size >= SLICE_CHARS:
                self._add(pieces, out)
                pieces, size = [], 0
        self._add(pieces, out)
        return out

    def _add(self, pieces: list[tuple[int, list[str]]], out: list[int]) -> None:
        new = list({x for _, found in pieces for x in found}.difference(self.known))
        if len(self.known) + len(new) > PIECE_CACHE:
            self.known = {}
            new = list({x for _, found in pieces for x in found})
        self.known.update(zip(new, self._library(new), strict=True))
        for k, found in pieces:
            out[k] += sum(map(self.known.__getitem__, found))


class SentencePieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def counter(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return SentencePieceCounter(path) if path.endswith(".model") else ByteLevelCounter(path)


def version_digest(tokenizer_path: str) -> str:
    """Names a tokenizer version: the vocabulary's bytes and how it is applied."""
    with open(tokenizer_path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no added tokens, no truncation, no padding").hexdigest()


def _count(tokenizer_path: str):
    def run(batches):
        own = counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.counts(texts.to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(df: DataFrame, tokenizer_path: str, cache_dir: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens and digest of each row of df; appends missing counts to the cache.

    tokenizer_path must be readable on the driver and on each executor, cache_dir by Spark. The
    only normalisation that keeps counts exact is null to empty, so null and empty texts both
    have 0 bytes and 0 tokens. Repeated texts are encoded once and each row gets their count;
    repeated rows stay. Other columns of df are not read. Nothing is appended for an empty table. A row whose
    count is neither in the cache nor among those appended ends the job with an error; none is left out.
    """
    spark = df.sparkSession
    path = f"{cache_dir}/version={version_digest(tokenizer_path)}"
    with_text(df, text_col)
    rows = df.select(F.col(id_col), text_of(text_col).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    distinct = rows.groupBy("digest").agg(F.any_value("text").alias("text"))
    earlier = _runs(spark, path)
    if earlier:
        distinct = distinct.join(_stored(spark, earlier), "digest", "left_anti")
    own = f"{path}/{RUN}{uuid.uuid4().hex}"
    distinct.mapInArrow(_count(tokenizer_path), "digest binary, n_tokens bigint").write.parquet(own)
    sizes = rows.select(id_col, F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    # written, so that the join can be split where one text is in a third of all rows
    known = materialise(_stored(spark, [*earlier, own]), "known-counts")
    count = F.coalesce("n_tokens", F.raise_error(F.concat(F.lit("no count for the text with digest "), F.hex("digest"))).cast("long"))
    return sizes.join(known, "digest", "left").select(id_col, "n_bytes", count.alias("n_tokens"), "digest")


def _runs(spark, path: str) -> list[str]:
    """The folders of the runs that have ended, one for each run."""
    if not path_exists(spark, path):
        return []
    fs, at = hadoop_path(spark, path)
    found = [x.getPath().toString() for x in fs.listStatus(at) if x.getPath().getName().startswith(RUN)]
    return sorted(x for x in found if path_exists(spark, f"{x}/_SUCCESS"))


def _stored(spark, runs: list[str]) -> DataFrame:
    """The counts of some runs, with one row for each digest."""
    stored = spark.read.schema("digest binary, n_tokens bigint").parquet(*runs)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
