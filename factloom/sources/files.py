"""Text uploads and raw pages as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """upload_id, file_name and text of each file below path, whole; the id is six digits of the text's digest."""
    rows = spark.read.text(path, wholetext=True).select("value", "_metadata.file_name")
    return rows.select(F.substring(F.sha2("value", 256), 1, 6).alias("upload_id"), "file_name", F.col("value").alias("text"))


def fact_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """Extraction results in JSON lines, read by an explicit schema."""
    return spark.read.schema(schema).json(path)
