"""Windowed counts of events. The same function serves batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.staging import hadoop_path


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New event files below path, or the one file that path is, as a stream, with ts as a timestamp (event time must be one)."""
    files, at = hadoop_path(spark, path)
    reader = spark.readStream.schema(schema)
    if files.exists(at) and files.getFileStatus(at).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events and their sum by day and type. late is how long a stream waits for late rows."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    counts = rows.groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total_cents"))
    return counts.select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total_cents")


def sessions(events: DataFrame, gap: str = "1 hour", late: str | None = None) -> DataFrame:
    """Each user's sessions: events no more than gap apart."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
