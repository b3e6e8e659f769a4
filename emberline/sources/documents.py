"""Nested scene-statistics documents and the cited-event file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATS_SCHEMA = (
    "array<struct<interval:struct<`from`:string,`to`:string>,outputs:map<string,struct<bands:"
    "map<string,struct<stats:struct<mean:double,max:double,sampleCount:long,noDataCount:long,"
    "percentiles:map<string,double>>>>>>>>")


def band_stats(document: Column, output: str) -> Column:
    """Statistics of an output's band: key B0 when present, else whichever band is there."""
    bands = F.try_element_at(document["outputs"], F.lit(output))["bands"]
    return F.coalesce(F.try_element_at(bands, F.lit("B0")),
                      F.get(F.map_values(bands), 0))["stats"]


def scenes(df: DataFrame, json_col: str, keep: tuple[str, ...], output: str = "nbr") -> DataFrame:
    """One row per acquisition interval of a statistics document."""
    parsed = df.withColumn("_doc", F.explode(F.from_json(json_col, STATS_SCHEMA)))
    stats = band_stats(F.col("_doc"), output)
    return parsed.select(
        *keep, F.substring(F.col("_doc.interval.from"), 1, 10).try_cast("date").alias("scene_date"),
        stats["mean"].alias("nbr_mean"), stats["max"].alias("band_max"),
        stats["sampleCount"].alias("sample_count"), stats["noDataCount"].alias("no_data_count"),
        F.coalesce(F.try_element_at(stats["percentiles"], F.lit("25.0")),
                   F.try_element_at(stats["percentiles"], F.lit("25"))).alias("p25"))


EVENT_FIELDS = ("event_name", "lat", "lon", "start_date", "end_date", "label", "served_label",
                "confidence", "source", "radius_km", "notes")
EVENT_LABELS = ("PERSISTENT_BASELINE", "ACCIDENTAL_FIRE", "AGRICULTURAL_BURN",
                "TRANSIENT_HOTSPOT")


def check_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with reason) rows of a text event table; a citation is mandatory."""
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    start, end = (F.col(c).cast("string").try_cast("date") for c in ("start_date", "end_date"))
    radius = F.coalesce(F.col("radius_km").try_cast("double"), F.lit(3.0))
    reason = F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "no citation") \
        .when(~F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False)),
              "bad coordinates") \
        .when(start.isNull() | end.isNull(), "bad dates").when(end < start, "ends before start") \
        .when(~F.coalesce(F.col("label").isin(*EVENT_LABELS), F.lit(False)), "unknown label") \
        .when(radius <= 0, "bad radius")
    checked = raw.withColumn("label", F.upper(F.trim("label"))).withColumn("reason", reason)
    good = checked.where("reason IS NULL").withColumns({
        "lat": lat, "lon": lon, "start_date": start, "end_date": end, "radius_km": radius}) \
        .drop("reason")
    return good, checked.where("reason IS NOT NULL")


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    schema = ", ".join(f"{c} string" for c in EVENT_FIELDS)
    return check_events(spark.read.schema(schema).option("header", True).csv(path))


def all_events(spark: SparkSession, seeds: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejected): the seed events and the good rows of an event file after them; no file, seeds alone.

    seeds: seq, event_name, lat, lon, start_date, end_date, radius_km and label as text. Rows of the
    file without a name are no events. They are numbered after the seeds in the order of their
    fields, so that the numbers do not depend on how the file is split; origin tells which is which.
    """
    columns = ["seq", "event_name", "lat", "lon", "start_date", "end_date", "radius_km", "label"]
    own = seeds.select(*columns, F.lit("seed").alias("origin"))
    try:
        good, bad = read_events(spark, path)
    except AnalysisException:
        return own, own.limit(0).select("event_name", F.lit("").alias("reason"))
    named = F.coalesce(F.trim("event_name"), F.lit("")) != ""
    last = F.coalesce(seeds.agg(F.max("seq")).scalar(), F.lit(0))
    # a file of events kept by hand: its rows are few, whatever the detections are
    order = Window.orderBy(*[F.col(c).asc_nulls_last() for c in columns[1:]])
    mine = good.where(named).withColumn("event_name", F.trim("event_name")) \
        .withColumn("seq", last + F.row_number().over(order)).select(*columns, F.lit("file").alias("origin"))
    return own.unionByName(mine), bad.where(named).select("event_name", "reason")
