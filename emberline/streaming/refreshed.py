"""Tables a refresh keeps up to date: touched buckets are rewritten beside the old, a version names what counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import incidents, skew
from emberline.sources import sinks

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class RefreshedTable:
    """A table dealt into buckets by its key, merged copy on write.

    A batch reads and writes only the buckets it has keys of. Its files stand in a folder of the
    new version; the version's manifest (bucket, version and batch that hold it, last batch) is written last, so
    readers see all of a batch or none, and a batch that has a manifest is not applied again.
    Choose buckets so that one fits a task; their number is fixed for the life of the table.
    """

    root: str
    key: str
    merge: Merge
    buckets: int = 64

    def manifest(self, spark: SparkSession) -> list:
        """Rows (bucket, held, written_by, batch_id, version) of the newest version, empty before the first batch."""
        path = f"{self.root}/manifest"
        if not sinks.exists(spark, path):
            return []
        rows = spark.read.parquet(path)
        last = rows.agg(F.max("version")).first()[0]
        return rows.where(F.col("version") == last).collect()     # a row for each bucket

    def _paths(self, rows: list) -> list[str]:
        return [f"{self.root}/data/version={r.held}/bucket={r.bucket}" for r in rows]

    def read(self, spark: SparkSession, only_batch: int | None = None) -> DataFrame | None:
        """The table as of its newest version; with only_batch just the buckets that this batch wrote."""
        rows = [r for r in self.manifest(spark) if only_batch is None or r.written_by == only_batch]
        if not rows:
            return None
        return spark.read.option("basePath", f"{self.root}/data").parquet(*self._paths(rows)).drop("version", "bucket")

    def apply(self, batch: DataFrame, batch_id: int) -> bool:
        """Merges a batch; False if it, or a later one, has been merged before."""
        spark = batch.sparkSession
        rows = self.manifest(spark)
        if rows and max(r.batch_id for r in rows) >= batch_id:
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = {r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()}
        version = 1 + max((r.version for r in rows), default=0)
        held = [r for r in rows if r.bucket in touched]
        old = spark.read.option("basePath", f"{self.root}/data").schema(batch.schema).parquet(*self._paths(held)) if held \
            else batch.limit(0)
        whole = self.merge(old.select(*batch.columns), batch).withColumn("bucket", bucket)
        if touched:
            whole.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket") \
                .parquet(f"{self.root}/data/version={version}")
        lines = [(r.bucket, r.held, r.written_by, batch_id) for r in rows if r.bucket not in touched]
        lines += [(b, version, batch_id, batch_id) for b in sorted(touched)]
        if lines:
            spark.createDataFrame(lines, "bucket int, held long, written_by long, batch_id long").coalesce(1) \
                .write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        return True


def insert_new(key: str) -> Merge:
    """Rows whose key is not there yet, each key once."""
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        once = skew.first_per_key(new, [key], [F.struct(*[F.col(c) for c in new.columns if c != key])])
        return old.unionByName(incidents.new_rows(once, old, key))
    return merge


def pool_baselines(cell: str) -> Merge:
    return lambda old, new: incidents.merge_baselines(old, new, cell).select(*new.columns)


@dataclass
class Refresh:
    """foreachBatch target: incidents by id and baselines by cell, with a record of every refresh.

    A detection that a refresh restates is inserted once. The baselines take in what the batch
    itself inserted, read back from the incident table, so a batch that broke off between the two
    tables ends with the same result when it is run again.
    """

    root: str
    cell: str = "area"
    buckets: int = 64
    incidents_table: RefreshedTable = field(init=False)
    baselines_table: RefreshedTable = field(init=False)

    def __post_init__(self):
        self.incidents_table = RefreshedTable(f"{self.root}/incidents", "detection_id", insert_new("detection_id"), self.buckets)
        self.baselines_table = RefreshedTable(f"{self.root}/baselines", self.cell, pool_baselines(self.cell), self.buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            self.incidents_table.apply(batch.withColumn("inserted_by", F.lit(batch_id).cast("long")), batch_id)
            written = self.incidents_table.read(spark, batch_id)
            n = 0
            if written is not None:
                fresh = written.where(F.col("inserted_by") == batch_id)
                n = fresh.count()
                self.baselines_table.apply(incidents.cell_baseline(fresh, self.cell), batch_id)
        except Exception as error:
            self._record(spark, batch_id, "FAILED", None, str(error)[:200])
            raise
        self._record(spark, batch_id, "OK" if n else "EMPTY", n, None)

    def _record(self, spark: SparkSession, batch_id: int, status: str, rows: int | None, reason: str | None) -> None:
        path = f"{self.root}/refreshes"
        tries = spark.read.parquet(path).where(F.col("batch_id") == batch_id).count() if sinks.exists(spark, path) else 0
        spark.createDataFrame([(batch_id, tries + 1, status, rows, reason)],
                              "batch_id long, attempt long, status string, rows long, reason string") \
            .withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def refresh_record(spark: SparkSession, root: str) -> DataFrame:
    """Refreshes, failures, rows and the time of the last success; a failed attempt moves no success."""
    rows = spark.read.parquet(f"{root}/refreshes")
    ok = F.col("status").isin("OK", "EMPTY")
    last = rows.groupBy("batch_id").agg(F.max_by(F.struct("status", "rows"), "attempt").alias("r"))
    # attempts and final outcomes meet on the batch, then fold to one row
    tries = rows.groupBy("batch_id").agg(F.count_if(~ok).alias("failed"), F.max(F.when(ok, F.col("at"))).alias("at"))
    return tries.join(last, "batch_id").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("failed").alias("failures"), F.sum("r.rows").alias("rows"),
        F.count_if(F.col("r.status") == "FAILED").alias("still_failing"), F.max("at").alias("last_success_at"))
