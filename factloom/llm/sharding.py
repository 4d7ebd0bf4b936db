"""Sharding by size-tiered compaction (operator 8), in DataFrame operations only.

A store is a folder of immutable Parquet shards and of numbered manifests. Arrivals are appended as small
shards, one for each arrival. A shard's tier is the power of FAN_IN by which it is larger than a small
shard (its files on average). compact() takes runs of FAN_IN or more files of one tier, merges them into
files of about target_bytes, and commits a manifest that names the new shards instead of the old ones.

A manifest holds what its version changes: a line for each shard that comes or goes. The shards of a
version are those that came up to it and have not gone, which is a join of a table, not a list on the
driver; only shards that are still to be merged are planned there. A manifest is written beside its name
and then renamed to it, which fails if that version is there already, so each version is committed by one
writer and readers see whole versions only. That holds where a rename never replaces a file, as on HDFS
and local disks; an object store needs a committer of its own.

A merge leaves the old shards in place, for readers of older versions and for other writers. vacuum()
deletes, after a time of grace, what an older manifest has let go and what no manifest ever named.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from contextlib import contextmanager, suppress
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fresh, hadoop_path, path_exists

#: Files of one tier that are merged, at least.
FAN_IN = 4
#: Runs that one job merges, so that its plan stays small.
RUNS_AT_ONCE = 64
#: Seconds for which a shard stays that the last version does not name: longer than any reader or writer takes.
GRACE_SECONDS = 7 * 24 * 3600
LINES = "name string, rows bigint, bytes bigint, tier int, version bigint, files bigint, gone boolean"
LOCATED = ("name", "rows", "tier", "version")


@dataclass(frozen=True)
class Shard:
    """A folder with one or more files of about the target size."""

    name: str
    rows: int
    bytes: int
    tier: int
    version: int
    files: int = 1


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@contextmanager
def _unions_apart(spark: SparkSession):
    """Keeps the parts of a union in tasks of their own: parts of one task each are otherwise read by one task together."""
    key = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class ShardStore:
    """The store in one folder that Spark can reach; target_bytes is the wanted size of a file."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int, small_bytes: int):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.small_bytes = target_bytes, small_bytes

    def versions(self) -> list[int]:
        if not path_exists(self.spark, f"{self.path}/manifests"):
            return []
        fs, at = hadoop_path(self.spark, f"{self.path}/manifests")
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def last(self) -> int:
        """The number of the last version, 0 before the first."""
        return max(self.versions(), default=0)

    def shards(self, version: int | None = None) -> DataFrame:
        """The shards of a version (by default the last one) as a table: name, rows, bytes, tier, version and files."""
        upto = [x for x in self.versions() if version is None or x <= version]
        if not upto:
            return self.spark.createDataFrame([], LINES).drop("gone")
        lines = self.spark.read.schema(LINES).json([f"{self.path}/manifests/{x:012d}.json" for x in upto])
        gone = lines.where("gone").select("name")
        return lines.where("NOT gone").join(gone, "name", "left_anti").drop("gone")

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """The number and shards of a version on the driver, for stores of few shards and for tests."""
        number = self.last() if version is None else version
        rows = self.shards(number).orderBy("version", "name").collect()
        return number, [Shard(**x.asDict()) for x in rows]

    def commit(self, version: int, come: list[Shard], gone: list[str] = ()) -> int:
        """Makes the given version of the one before it. Raises Conflict if there is one already."""
        fs, at = hadoop_path(self.spark, f"{self.path}/manifests/{version:012d}.json")
        _, beside = hadoop_path(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        lines = [json.dumps(asdict(x) | {"gone": False}) for x in come] + [json.dumps({"name": x, "version": version, "gone": True}) for x in gone]
        stream = fs.create(beside, False)
        try:
            stream.write(bytearray("".join(x + "\n" for x in lines).encode()))
        finally:
            stream.close()
        if fs.exists(at) or not fs.rename(beside, at):
            fs.delete(beside, False)
            raise Conflict(f"version {version} is committed already")
        return version

    def tier(self, size: float) -> int:
        return max(0, int(math.log(max(1, size / self.small_bytes), FAN_IN) + 1e-9))

    def _written(self, batch: str, number: str, schema, version: int) -> list[tuple[int, Shard]]:
        """The shards of a batch, by their number, as tasks have measured them: rows, bytes and files."""
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/shards/{batch}").select(F.col(number).alias("number"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
        files = rows.groupBy("number", "path", "size").agg(F.count("*").alias("rows"))
        found = files.groupBy("number").agg(F.sum("rows").alias("rows"), F.sum("size").alias("bytes"), F.count("*").alias("files")).orderBy("number").collect()  # a row for each new shard
        return [(x["number"], Shard(f"{batch}/{number}={x['number']}", x["rows"], x["bytes"], self.tier(x["bytes"] / x["files"]), version, x["files"])) for x in found]

    def append(self, arrivals: DataFrame, arrival_col: str) -> int:
        """Adds the rows as one shard for each number in arrival_col (null counts as one), in one version.

        An arrival is one immutable folder; its files are as large as the tasks that wrote them. Rows are
        kept as they are: nulls, repeated rows, empty and long texts, any column names. arrival_col itself
        is not stored. No rows make a version with no new shard. If other writers commit meanwhile, the shards come
        in the version after theirs.
        """
        batch = uuid.uuid4().hex[:12]
        number = fresh("arrival", *arrivals.columns)
        rows = arrivals.withColumn(number, F.coalesce(F.col(arrival_col).cast("long"), F.lit(-1))).drop(arrival_col)
        rows.write.option("compression", "zstd").partitionBy(number).parquet(f"{self.path}/shards/{batch}")
        new = [x for _, x in self._written(batch, number, rows.schema, 0)]
        while True:
            version = self.last() + 1
            with suppress(Conflict):
                return self.commit(version, [replace(x, version=version) for x in new])

    def read(self, shards: list[Shard], schema) -> DataFrame:
        """The rows of the given shards."""
        return self._read([x.name for x in shards], schema)

    def _read(self, names: list[str], schema) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/shards/{x}" for x in names))

    def located(self, schema, into: str = "located", version: int | None = None) -> DataFrame:
        """The rows of a version (by default the last) with their shard as a struct column: name, rows, tier and version.

        into names that column; it may not be a column of the rows. An empty store gives no rows.
        """
        if fresh(into, *schema.names) != into:
            raise ValueError(f"the rows have a column {into} already")
        known = self.shards(version)
        names = [x["name"] for x in known.select("name").collect()]  # paths to read, as any reader lists them
        file, own = fresh("file", *schema.names, into), fresh("name", *schema.names, into, "file")
        rows = self._read(names, schema)
        path = F.col("_metadata.file_path") if names else F.lit("")
        rows = rows.withColumn(file, F.regexp_extract(path, r"/shards/([^/]+/[^/]+)/[^/]+$", 1))
        known = known.select(F.col("name").alias(own), F.struct(*LOCATED).alias(into))
        return rows.join(known, F.col(file) == F.col(own)).select(*schema.names, into)

    def done(self, shard: Shard) -> bool:
        """Whether a shard has the target size and files of at least half of it, on average."""
        return shard.bytes >= self.target_bytes and 2 * shard.bytes >= self.target_bytes * shard.files

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """The runs to merge: shards of one tier that are not done, with FAN_IN or more files."""
        tiers: dict[int, list[Shard]] = {}
        for shard in shards:
            if not self.done(shard):
                tiers.setdefault(shard.tier, []).append(shard)
        runs = []
        for tier in sorted(tiers):
            run: list[Shard] = []
            for shard in sorted(tiers[tier], key=lambda x: (x.version, x.name)):
                run.append(shard)
                if sum(x.bytes for x in run) >= self.target_bytes and sum(x.files for x in run) >= FAN_IN:
                    runs.append(run)
                    run = []
            if sum(x.files for x in run) >= FAN_IN:
                runs.append(run)
        return runs

    def open_shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version (by default the last) that are still to be merged; those that are done stay in the table."""
        small = (F.col("bytes") < self.target_bytes) | (2 * F.col("bytes") < self.target_bytes * F.col("files"))
        return [Shard(**x.asDict()) for x in self.shards(version).where(small).collect()]

    def merge(self, base: int, runs: list[list[Shard]], schema) -> int:
        """Merges each run of shards of version base into files of about target_bytes and commits the outcome as version base + 1.

        If another writer has committed that version meanwhile, what it did may concern the same shards: Conflict is raised
        and nothing comes or goes. A merge is planned again then, never committed later.

        All runs are merged by one job. A run that fits one file is read by one task, one small file after
        the other; the rows of a larger run are dealt evenly to its files by a shuffle. Rows keep all their
        columns, whatever their names.
        """
        version, batch = base + 1, uuid.uuid4().hex[:12]
        number = fresh("run", *schema.names)
        files = [max(1, round(sum(x.bytes for x in run) / self.target_bytes)) for run in runs]
        parts = [(self.read(run, schema).coalesce(1) if n == 1 else self.read(run, schema).repartition(n)).withColumn(number, F.lit(k).cast("long")) for k, (run, n) in enumerate(zip(runs, files, strict=True))]
        merged = reduce(DataFrame.unionByName, parts)
        with _unions_apart(self.spark):
            merged.write.option("compression", "zstd").partitionBy(number).parquet(f"{self.path}/shards/{batch}")
        # a merged run is never in the tier that it came from, so that it is not merged alone again
        new = [replace(x, tier=max(x.tier, runs[k][0].tier + 1)) for k, x in self._written(batch, number, merged.schema, version)]
        return self.commit(version, new, [x.name for run in runs for x in run])

    def compact(self, schema) -> int:
        """Merges until no tier holds FAN_IN files of shards that are not done; the last version's number.

        Nothing is deleted: readers of older versions and other writers go on undisturbed. Each merge is planned from one
        version and makes the next; where another writer was faster, it is planned again from what that one left.
        Rows keep their number and columns: nulls, repeated rows, empty and long texts. An empty store stays as it is.
        """
        while True:
            base = self.last()
            runs = self.plan(self.open_shards(base))
            if not runs:
                return base
            with suppress(Conflict):
                self.merge(base, runs[:RUNS_AT_ONCE], schema)

    def vacuum(self, grace_seconds: float = GRACE_SECONDS) -> int:
        """Deletes shards that the last version does not name and that nothing has touched for grace_seconds; their number.

        A shard that a manifest let go counts from that manifest's time, one that no manifest names from its
        own: another writer may be about to commit it. Folders of batches are listed one by one.
        """
        fs, at = hadoop_path(self.spark, f"{self.path}/shards")
        if not fs.exists(at):
            return 0
        named = {x["name"] for x in self.shards().select("name").collect()}
        let_go = {}
        for version in self.versions():
            _, manifest = hadoop_path(self.spark, f"{self.path}/manifests/{version:012d}.json")
            let_go[version] = fs.getFileStatus(manifest).getModificationTime()
        lines = self.spark.read.schema(LINES).json(f"{self.path}/manifests/*.json") if let_go else self.spark.createDataFrame([], LINES)
        since = {x["name"]: let_go[x["version"]] for x in lines.where("gone").select("name", "version").collect()}
        now, deleted = time.time() * 1000, 0
        for batch in fs.listStatus(at):
            shards = [x for x in fs.listStatus(batch.getPath()) if x.isDirectory() and "=" in x.getPath().getName()]
            left = len(shards)
            for x in shards:
                name = f"{batch.getPath().getName()}/{x.getPath().getName()}"
                if name not in named and now - max(since.get(name, 0), x.getModificationTime()) >= grace_seconds * 1000:
                    fs.delete(x.getPath(), True)
                    left, deleted = left - 1, deleted + 1
            if not left and now - batch.getModificationTime() >= grace_seconds * 1000:
                fs.delete(batch.getPath(), True)
        return deleted
