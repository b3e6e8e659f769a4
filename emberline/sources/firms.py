"""Detection feeds: landed CSV files, availability, archive request plan, union and dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline import constants as C
from emberline.functions.text import acquisition_timestamp, clock_digits, number
from emberline.operators import skew

NUMERIC = ("latitude", "longitude", "bright_ti4", "scan", "track", "bright_ti5", "frp")
#: Numeric columns that only some feeds have.
MORE_NUMERIC = ("brightness", "bright_t31")
TEXT = ("satellite", "instrument", "confidence", "version", "daynight")
CSV_COLUMNS = ("latitude", "longitude", "bright_ti4", "scan", "track", "acq_date", "acq_time",
               "satellite", "instrument", "confidence", "version", "bright_ti5", "frp", "daynight")
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CSV_COLUMNS])
ERROR_TEXT = "Invalid MAP_KEY|Bad Request"


def empty(spark: SparkSession) -> DataFrame:
    """No rows, full typed schema."""
    return typed(spark.createDataFrame([], RAW_SCHEMA))


def typed(raw: DataFrame) -> DataFrame:
    """Numbers, dates and instants from text columns; rows without a usable place are dropped."""
    for name in CSV_COLUMNS:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    placed = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    extra = [number(F.col(c)).alias(c) if c in MORE_NUMERIC else F.col(c)
             for c in raw.columns if c not in CSV_COLUMNS + ("timestamp_utc",)]
    return raw.where(placed).select(
        *[number(F.col(c)).alias(c) for c in NUMERIC],
        *[F.col(c).cast("string").alias(c) for c in TEXT],
        F.trim("acq_date").try_cast("date").alias("acq_date"),
        clock_digits("acq_time").alias("acq_time"),
        acquisition_timestamp("acq_date", "acq_time").alias("timestamp_utc"), *extra)


def read_csv(spark: SparkSession, path: str | Sequence[str],
             columns: Sequence[str] = CSV_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(detections, rejected files) of one feed's landed CSV files.

    ``columns`` is the feed's own layout; columns beyond the common ones stay text. An error
    payload has neither a header nor rows with a place, so it adds nothing; its file is listed.
    """
    paths = [path] if isinstance(path, str) else list(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = (spark.read.schema(schema).option("header", True).csv(paths)
            .withColumn("source_file", F.col("_metadata.file_path")))
    bad = (spark.read.text(paths).select(F.col("_metadata.file_path").alias("source_file"), "value")
           .where(F.col("value").rlike(ERROR_TEXT))
           .groupBy("source_file").agg(F.first("value").alias("reason")))
    return typed(rows), bad


def availability(rows: DataFrame) -> DataFrame:
    """(data_id, min_date, max_date); rows with unreadable dates are dropped."""
    return rows.select(
        "data_id", F.col("min_date").cast("string").try_cast("date").alias("min_date"),
        F.col("max_date").cast("string").try_cast("date").alias("max_date")) \
        .where("min_date IS NOT NULL AND max_date IS NOT NULL")


def counterpart(source: Column) -> Column:
    """The other variant of a feed: near-real-time <-> science quality."""
    pairs = {**C.SENSOR_VARIANTS, **{v: k for k, v in C.SENSOR_VARIANTS.items()}}
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.try_element_at(table, source)


def request_plan(sensors: DataFrame, available: DataFrame, page_days: int = C.PAGE_DAYS
                 ) -> DataFrame:
    """Page windows per sensor with the feed variant that covers each window's start.

    ``sensors`` holds (sensor, start_date, end_date). The preferred variant wins, then its
    counterpart, else the window is SKIPPED. Feeds are an equi-join on the name; a sensor has two.
    """
    windows = sensors.select(
        "sensor", "end_date", F.explode(F.expr(
            f"sequence(start_date, end_date, interval {page_days} days)")).alias("window_start")) \
        .select("sensor", "window_start", F.least(
            F.date_add("window_start", page_days - 1), F.col("end_date")).alias("window_end"))
    variants = windows.withColumn("v", F.explode(F.array(
        F.struct(F.lit(0).alias("pref"), F.col("sensor").alias("data_id")),
        F.struct(F.lit(1).alias("pref"), counterpart(F.col("sensor")).alias("data_id"))))) \
        .select("sensor", "window_start", "window_end", "v.*")
    covered = variants.join(available, "data_id", "left").withColumn(
        "ok", F.coalesce(F.col("window_start").between(F.col("min_date"), F.col("max_date")),
                         F.lit(False)))
    return covered.groupBy("sensor", "window_start", "window_end").agg(
        F.min_by("data_id", F.when(F.col("ok"), F.col("pref"))).alias("data_id")) \
        .withColumn("resolution", F.when(F.col("data_id").isNull(), "SKIPPED").otherwise("REQUEST"))


def window_outcomes(plan: DataFrame, landed: DataFrame) -> DataFrame:
    """OK / EMPTY / REQUEST_FAILED / SKIPPED per window from the landed-file manifest."""
    manifest = landed.select("sensor", "window_start", F.col("rows").alias("_rows"),
                             F.lit(True).alias("_landed"))
    status = F.when(F.col("resolution") == "SKIPPED", "SKIPPED") \
        .when(F.col("_landed").isNull(), "REQUEST_FAILED") \
        .when(F.col("_rows") == 0, "EMPTY").otherwise("OK")
    return plan.join(manifest, ["sensor", "window_start"], "left").select(
        *plan.columns, F.coalesce("_rows", F.lit(0)).alias("rows"), status.alias("status"))


def tally(outcomes: DataFrame) -> DataFrame:
    """Outcome counts per sensor with the two alarms worth waking someone for."""
    counts = outcomes.groupBy("sensor").agg(
        *[F.count_if(F.col("status") == s).alias(s.lower())
          for s in ("OK", "EMPTY", "REQUEST_FAILED", "SKIPPED")], F.sum("rows").alias("rows"))
    tried = F.col("ok") + F.col("empty") + F.col("request_failed")
    return counts.withColumn("alarm", F.when(
        (tried > 0) & (F.col("request_failed") == tried), "EVERY_REQUEST_FAILED").when(
        (tried > 0) & (F.col("empty") == tried), "EVERY_WINDOW_EMPTY"))


def union_feeds(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name in priority order; ``feed_rank`` remembers the order."""
    out = None
    for rank, frame in enumerate(frames):
        ranked = frame.withColumn("feed_rank", F.lit(rank))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    return out


def dedupe(df: DataFrame, tie: Sequence[str] = ("feed_rank", "ingest_id"),
           keys: Sequence[str] = C.DEDUPE_KEYS) -> DataFrame:
    """One row per place, acquisition and satellite: the first by feed, then by ingest id."""
    order = [F.col(c) for c in tie if c in df.columns]
    return skew.first_per_key(df, keys, order or [F.lit(0)])
