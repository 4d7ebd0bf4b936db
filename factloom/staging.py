"""Tables that a job writes between its steps, in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The setting by which a query's shuffle files are deleted when it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a slice, about, and slices at most. While one slice is shuffled the others lie in compressed tables.
SLICE_ROWS, MOST_SLICES = 4_000_000, 16
#: Tables that are written while a scratch() is open.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system and path object behind a path string."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop_path(spark, path)
    return fs.exists(at)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and every executor can see.

    It lies below the session's spark.checkpoint.dir; where that is unset a temporary folder is made
    and set, but only if the session runs on this machine alone: elsewhere executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/factloom/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile leave no shuffle files behind. What they write stays, so nothing reads those files again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised meanwhile are deleted at the end; what was made of them must be written by then."""
    token = _SCRATCH.set(own := [])
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in own:
            delete(spark, path)


def materialise(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes df to a shared folder and reads it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = folder or shared_folder(spark, name)
    if (own := _SCRATCH.get()) is not None:
        own.append(path)
    with shuffles_end(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices_of(rows: int) -> int:
    """Into how many slices so many rows are dealt."""
    return max(1, min(MOST_SLICES, -(-rows // SLICE_ROWS)))


def in_slice(df: DataFrame, key: str, slices: int, k: int) -> DataFrame:
    """The rows of df that a table dealt by key has in slice k."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(slices)) == k)


class Dealt:
    """A table dealt into slices by the hash of its key, without a shuffle. Each slice is read, and deleted, by itself."""

    def __init__(self, df: DataFrame, key: str, slices: int, name: str):
        self.spark, self.schema, self.folder = df.sparkSession, df.schema, shared_folder(df.sparkSession, name)
        number = F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")
        with shuffles_end(self.spark):  # sorted by key, a slice takes less room
            df.withColumn("slice", number).sortWithinPartitions("slice", key).write.option("compression", "zstd").partitionBy("slice").parquet(self.folder)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder).select(*self.schema.names)

    def slice(self, k: int) -> DataFrame:
        path = f"{self.folder}/slice={k}"
        return self.spark.read.schema(self.schema).parquet(path) if path_exists(self.spark, path) else self.spark.createDataFrame([], self.schema)

    def drop(self, k: int) -> None:
        delete(self.spark, f"{self.folder}/slice={k}")


def by_slices(spark: SparkSession, slices: int, build: Callable[[int], DataFrame], name: str, read: Iterable[Dealt] = ()) -> DataFrame:
    """The rows that build(k) gives for all slices k, which are made one after the other.

    So no more than one slice's shuffles and steps take room at a time, however large the tables. read has the dealt
    tables that build reads; a slice's part of them is deleted when its rows are written.
    """
    folder = shared_folder(spark, name)
    for k in range(slices):
        with scratch(spark), shuffles_end(spark):
            found = build(k)
            found.write.mode("append").option("compression", "zstd").parquet(folder)
        for table in read:
            table.drop(k)
    return spark.read.schema(found.schema).parquet(folder)


class Rounds:
    """The table that a loop carries from round to round. Each round's is written, and then the one before it deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.folder = spark, name, None

    def write(self, df: DataFrame) -> DataFrame:
        folder = shared_folder(self.spark, self.name)
        written = materialise(df, self.name, folder)
        self.drop()
        self.folder = folder
        return written

    def drop(self) -> None:
        """Deletes the last table, when nothing reads it any more."""
        if self.folder:
            delete(self.spark, self.folder)
        self.folder = None
