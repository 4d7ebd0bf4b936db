"""Pages kept up to date by a stream of facts: only pages that a batch touches are built again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.staging import path_exists

#: Folders that a page's facts are dealt to, so that a batch reads those of its pages only.
BUCKETS = 64


def summary(sides: DataFrame) -> DataFrame:
    """page_id, facts, neighbours and updated of each page, from its facts as seen from it."""
    return sides.groupBy("page_id").agg(F.count("*").alias("facts"), F.count_distinct("other_id").alias("neighbours"), F.max("ts").alias("updated"))


class PageUpkeep:
    """Takes batches of facts (fact_id, ts, subject_id, predicate, object_id) and keeps pages in a shared folder.

    A fact that comes again, in a batch or in a later one, counts once. A fact that is older than the newest one of
    earlier batches by more than late is not taken in but kept in a table of its own. Each batch writes what it
    brings into folders of its number and reads those of smaller numbers only, so a batch that Spark
    repeats after a failure writes the same again. Pages are built by a function of their facts as seen from
    both ends (page_id, other_id, direction and the columns of facts), to one row for each page_id.

    Use it as a sink: stream.writeStream.foreachBatch(PageUpkeep(spark, folder, "2 days")).option("checkpointLocation", ...).start().
    """

    def __init__(self, spark: SparkSession, folder: str, late: str, build: Callable[[DataFrame], DataFrame] = summary):
        self.spark, self.folder, self.late, self.build = spark, folder.rstrip("/"), late, build

    def _write(self, df: DataFrame, table: str, number: int, *by: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.folder}/{table}/batch={number}")

    def table(self, name: str, before: int | None = None) -> DataFrame | None:
        """sides, late, marks or pages as far as they were written, with the number of their batch; None if there is nothing."""
        if not path_exists(self.spark, f"{self.folder}/{name}"):
            return None
        rows = self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def __call__(self, batch: DataFrame, number: int) -> None:
        # the batch's own session is another one, but writes and reads go by path
        facts = batch.where("fact_id IS NOT NULL").dropDuplicates(["fact_id"]).persist()
        try:
            self._take(facts, number)
        finally:
            facts.unpersist()

    def _take(self, facts: DataFrame, number: int) -> None:
        marks = self.table("marks", number)
        newest = marks.agg(F.max("newest")).first()[0] if marks is not None else None
        horizon = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL '{self.late}'") if newest is not None else F.lit(None).cast("timestamp")
        is_late = F.coalesce(F.col("ts") < horizon, F.lit(False))
        self._write(facts.where(is_late), "late", number)
        fresh = facts.where(~is_late)
        sides = self.table("sides", number)
        if sides is not None:  # what is not late can only repeat what is not late
            known = sides.where("direction = 'out'").where(F.coalesce(F.col("ts") >= horizon, F.lit(True)))
            fresh = fresh.join(known.select("fact_id"), "fact_id", "left_anti")
        ends = F.array(
            F.struct(F.col("subject_id").alias("page_id"), F.lit("out").alias("direction"), F.col("object_id").alias("other_id")),
            F.struct(F.col("object_id").alias("page_id"), F.lit("in").alias("direction"), F.col("subject_id").alias("other_id")),
        )
        seen = fresh.select("*", F.inline(ends)).withColumn("bucket", F.pmod(F.xxhash64("page_id"), F.lit(BUCKETS)).cast("int"))
        self._write(seen.repartition("bucket"), "sides", number, "bucket")
        self._write(facts.agg(F.max("ts").alias("newest")), "marks", number)
        changed = self.table("sides").where(F.col("batch") == number).select("bucket", "page_id").distinct()
        known = self.table("sides", number + 1).join(changed, ["bucket", "page_id"], "left_semi")
        self._write(self.build(known.drop("batch", "bucket")), "pages", number)

    def pages(self) -> DataFrame:
        """Each page as it was built last."""
        found = self.table("pages")
        columns = [c for c in found.columns if c not in ("page_id", "batch")]
        last = found.groupBy("page_id").agg(F.max_by(F.struct(*columns), "batch").alias("last"))
        return last.select("page_id", "last.*")

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Takes in all that the stream's source has now, and gives the pages."""
        stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return self.pages()
