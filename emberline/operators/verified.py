"""Cited reference events: tagging detections, scoring per event, classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions import geo
from emberline.operators import tiles as T
from emberline.operators.proximity import POINTS_PER_PART, circle_bounds


def attach_events(df: DataFrame, events: DataFrame, tile_deg: float = 0.5) -> DataFrame:
    """Tag detections inside an event's circle and dates.

    The smallest radius wins, a later event wins a tie. The last day counts in full and the day
    after it not at all.
    """
    start = F.unix_micros(F.col("start_date").cast("timestamp"))
    stop = F.unix_micros(F.date_add("end_date", 1).cast("timestamp"))
    layer = T.build_layer(
        events, circle_bounds(F.col("lat"), F.col("lon"), F.col("radius_km")),
        F.struct(F.col("radius_km").alias("r"), (-F.col("seq")).alias("order"), "lat", "lon",
                 start.alias("start"), stop.alias("stop"), F.col("event_name").alias("name"),
                 "label"),
        tile_deg, item_bytes=120, per_part=POINTS_PER_PART)
    lat, lon, us = F.col("latitude"), F.col("longitude"), F.unix_micros("timestamp_utc")

    def hit(items):
        return T.first_match(items, lambda e: (us >= e["start"]) & (us < e["stop"]) & (
            geo.equirectangular_km(lat, lon, e["lat"], e["lon"]) <= e["r"]))

    found = T.lookup(df, layer, hit, name="_event", inputs=("latitude", "longitude", "timestamp_utc"))
    return found.select(*df.columns, F.col("_event.name").alias("event_name"),
                        F.col("_event.label").alias("event_label"),
                        (-F.col("_event.order")).alias("event_seq"))


def first_corpus(tagged: DataFrame, event_col: str = "event_name",
                 rank_col: str = "corpus_rank") -> DataFrame:
    """Rows of each event from the first corpus (lowest rank) that contains it."""
    best = tagged.where(F.col(event_col).isNotNull()).groupBy(event_col) \
        .agg(F.min(rank_col).alias(rank_col))
    return tagged.join(best, [event_col, rank_col], "left_semi")


def event_accuracy(df: DataFrame, truth: Column, predicted: Column,
                   event_col: str = "event_name") -> DataFrame:
    """Rows and share of agreeing answers per event, thin events flagged."""
    return df.where(F.col(event_col).isNotNull()).groupBy(event_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((truth == predicted).cast("double")).alias("accuracy")) \
        .withColumn("support", F.when(F.col("n") < C.LOW_SUPPORT, "LOW_SUPPORT").otherwise("OK"))


def register(df: DataFrame, events: DataFrame, truth: Column, served: Column, model: Column,
             event_col: str = "event_name") -> DataFrame:
    """One row per cited event, served and model accuracy side by side, best served first.

    Events without any scored row stay, with no accuracy.
    """
    seen = df.where(F.col(event_col).isNotNull()).groupBy(event_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((truth == served).cast("double")).alias("served_accuracy"),
        F.avg((truth == model).cast("double")).alias("model_accuracy"))
    return (events.select(event_col).distinct().join(seen, event_col, "left")
            .withColumn("n", F.coalesce("n", F.lit(0)))
            .withColumn("support", F.when(F.col("n") == 0, "NOT_SCORED")
                        .when(F.col("n") < C.LOW_SUPPORT, "LOW_SUPPORT").otherwise("OK"))
            .orderBy(F.desc_nulls_last("served_accuracy"), F.desc("n"), event_col))


def confusion(df: DataFrame, truth: Column, predicted: Column,
              slices: list[Column] | None = None) -> DataFrame:
    return df.groupBy(*(slices or []), truth.cast("string").alias("truth"),
                      predicted.cast("string").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def class_report(counts: DataFrame, slices: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 per class from confusion counts.

    Every count row speaks for its true class and its predicted class, so classes seen on either
    side appear.
    """
    slices = slices or []
    hit = F.col("truth") == F.col("predicted")
    sides = F.explode(F.array(
        F.struct(F.col("truth").alias("cls"), F.col("n").alias("actual"),
                 F.lit(0).cast("long").alias("called"),
                 F.when(hit, F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("actual"),
                 F.col("n").alias("called"), F.lit(0).cast("long").alias("tp"))))
    per = counts.select(*slices, sides.alias("s")).select(*slices, "s.*") \
        .groupBy(*slices, "cls").agg(F.sum("actual").alias("support"),
                                     F.sum("called").alias("called"), F.sum("tp").alias("tp"))
    precision = F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    both = F.col("called") + F.col("support")
    f1 = F.when(both > 0, 2.0 * F.col("tp") / both).otherwise(0.0)
    return per.select(*slices, "cls", "support", precision.alias("precision"),
                      recall.alias("recall"), f1.alias("f1"))


def overall(report: DataFrame, slices: list[str] | None = None) -> DataFrame:
    """Accuracy, macro F1 and weighted F1 from a class report."""
    total = F.sum("support")
    return report.groupBy(*(slices or [])).agg(
        total.alias("n"), (F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"))


def log_loss(df: DataFrame, truth_index: Column, probabilities: Column) -> DataFrame:
    p = F.greatest(F.least(F.get(probabilities, truth_index), F.lit(1 - 1e-15)), F.lit(1e-15))
    return df.agg(F.avg(-F.ln(p)).alias("log_loss"))


def counter_register(undetected: DataFrame, events: DataFrame) -> DataFrame:
    """Incidents the sensors missed, beside how many cited events there are."""
    n = events.agg(F.count(F.lit(1))).scalar()
    return undetected.withColumn("verified_events", n)
