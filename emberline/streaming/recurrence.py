"""Detections as a stream: exact history per micro-batch, restated and late rows, progress."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.operators import incidents, recurrence, skew
from emberline.sources import sinks
from emberline.sources.firms import RAW_SCHEMA, typed


def read_landing(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New CSV files of a landing folder as typed rows."""
    raw = (spark.readStream.schema(RAW_SCHEMA).option("header", True)
           .option("maxFilesPerTrigger", files_per_trigger).csv(path))
    return typed(raw)


def read_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000
               ) -> DataFrame:
    return spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_per_trigger).parquet(path)


@dataclass
class RecurrenceSink:
    """foreachBatch target that keeps history, scored rows, late rows and progress as tables.

    Each batch rescores exactly the rows that its arrivals can change: those of the touched
    sources and areas from the batch's earliest instant on. The history of the sources involved
    is read back for that, because first sight and persistence outlive the thirty-day window.
    A late row is listed as such and scored like any other, with all that it changes. With ``keys``
    (place, acquisition and satellite) a detection that an overlapping refresh restates is taken
    once, however late; no watermark drops rows before they are seen.
    Every table is partitioned by batch id and written with overwrite, so replaying a batch
    after a lost executor or driver leaves the same result.
    """

    root: str
    late_after_days: int = 3
    keys: tuple[str, ...] = ()
    cfg: recurrence.RecurrenceConfig = field(default_factory=recurrence.RecurrenceConfig)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _before(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame | None:
        path = self._path(name)
        if not sinks.exists(spark, path):
            return None
        return spark.read.parquet(path).where(F.col("batch_id") < batch_id)

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        (df.drop("batch_id").write.mode("overwrite")
         .parquet(f"{self._path(name)}/batch_id={batch_id}"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            self._apply(spark, batch, batch_id)
        finally:
            batch.unpersist()

    def _apply(self, spark: SparkSession, batch: DataFrame, batch_id: int) -> None:
        known = self._before(spark, "history", batch_id)
        span = batch.agg(F.min("us").alias("low"), F.count(F.lit(1)).alias("n")).first()
        newest = None if known is None else known.agg(F.max("us")).first()[0]
        cut = None if newest is None else newest - self.late_after_days * C.DAY_US
        fresh = batch
        if self.keys:
            fresh = skew.first_per_key(fresh, self.keys, [F.col("detection_id")])
            if known is not None:
                old = known.select(*[F.col(k).alias(f"_old_{k}") for k in self.keys])
                same = [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in self.keys]
                fresh = fresh.join(old, same, "left_anti")
        if known is not None:
            fresh = incidents.new_rows(fresh, known)
        late = fresh.where(F.lit(False) if cut is None else F.col("us") < cut)
        self._write(late, "late", batch_id)
        self._write(fresh, "history", batch_id)
        if span.n:
            self._write(self.rescore(spark, fresh, known), "scored", batch_id)
        status = F.when(F.count(F.lit(1)) > 0, "OK").otherwise("EMPTY")
        self._write(fresh.agg(status.alias("status"), F.count(F.lit(1)).alias("rows"),
                              F.max("us").alias("last_success_us")), "progress", batch_id)

    def rescore(self, spark: SparkSession, fresh: DataFrame, known: DataFrame | None
                ) -> DataFrame:
        """Scored rows of the areas and sources the new rows touch."""
        if known is None:
            return recurrence.evaluate(fresh, self.cfg)
        everything = known.drop("batch_id").unionByName(fresh)
        low = fresh.agg(F.min("us")).scalar()
        keys = fresh.select("recurrence_key").distinct()
        areas = fresh.select("area").distinct()
        # rows to rescore lie in touched areas or belong to touched sources; counting their
        # neighbours needs every source of every area those rows lie in
        wide = everything.join(keys, "recurrence_key", "left_semi").select("area") \
            .unionByName(areas).distinct()
        related = everything.join(wide, "area", "left_semi").select("recurrence_key").distinct()
        context = everything.join(related, "recurrence_key", "left_semi")
        start = everything.agg(F.min("us")).scalar()
        touched = F.col("us") >= low
        scored = recurrence.evaluate(context, self.cfg, corpus_start=start)
        return scored.where(touched).join(
            keys.withColumn("_k", F.lit(True)), "recurrence_key", "left").join(
            areas.withColumn("_a", F.lit(True)), "area", "left").where(
            "_k OR _a").drop("_k", "_a")


def latest(spark: SparkSession, root: str) -> DataFrame:
    """Newest score of every detection across batches."""
    scored = spark.read.parquet(f"{root}/scored")
    names = [c for c in scored.columns if c != "batch_id"]
    newest = scored.groupBy("detection_id").agg(
        F.max_by(F.struct(*names), "batch_id").alias("r"))
    return newest.select("r.*")


def start(stream: DataFrame, sink: RecurrenceSink, checkpoint: str, once: bool = True):
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once
            else writer.trigger(processingTime="180 minutes")).start()


def refresh_status(spark: SparkSession, root: str) -> DataFrame:
    """Outcome of every refresh; last success only moves with an OK batch."""
    rows = spark.read.parquet(f"{root}/progress")
    return rows.agg(F.count(F.lit(1)).alias("runs"), F.sum("rows").alias("rows"),
                    F.max(F.when(F.col("status") == "OK", F.col("last_success_us")))
                    .alias("last_success_us"))
