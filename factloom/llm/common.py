"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.staging import hadoop_path, materialise, path_exists, shared_folder

__all__ = ["documents", "fresh", "give_back", "hadoop_path", "lower_ascii", "materialise", "path_exists", "shared_folder", "small_batches", "text_of", "with_text"]

#: The setting for bytes of a batch of rows on its way to Python, and what it is set to.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

#: The ASCII letters, for lower-casing A-Z and nothing else.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def fresh(name: str, *taken: str) -> str:
    """name, made longer until no column among taken has it (column names do not tell cases apart)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def give_back() -> None:
    """Returns memory that Arrow and the C library keep for later to the system, at a task's end: a worker waits, others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def small_batches(spark: SparkSession) -> None:
    """Lets the session hand texts to Python in batches of some megabytes, where it has no setting of its own for that."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def with_text(df: DataFrame, text_col: str) -> DataFrame:
    """df, checked to have the text column as a string."""
    kind = df.schema[text_col].dataType
    if not isinstance(kind, (T.StringType, T.NullType)):
        raise TypeError(f"{text_col} must be a string column, not {kind.simpleString()}")
    return df
