"""Burn-scar validation from scene statistics, and thermal acquisitions of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions import geo, rules
from emberline.functions.text import half_up
from emberline.operators import skew
from emberline.operators.quantiles import exact_percentiles


def locations(df: DataFrame, key: str = "recurrence_key") -> DataFrame:
    """Where and when each source first appeared, from one row of it."""
    first = F.min_by(F.struct("latitude", "longitude", "timestamp_utc"),
                     F.struct("timestamp_utc", "detection_id"))
    return df.groupBy(key).agg(first.alias("f"), F.max("frp").alias("peak_frp")).select(
        key, "f.latitude", "f.longitude", F.to_date("f.timestamp_utc").alias("event_date"),
        "peak_frp")


def candidates(df: DataFrame) -> DataFrame:
    """Fresh detections worth an optical look."""
    return df.where(rules.dnbr_candidate(F.col("inside_industrial"), F.col("frp"),
                                         F.col("n_30d")))


def uncached(locs: DataFrame, cache: DataFrame) -> DataFrame:
    """Locations without a stored answer for their rounded place and date."""
    def keyed(df):
        return df.withColumns({"_a": half_up(F.col("latitude"), 3),
                               "_b": half_up(F.col("longitude"), 3)})

    stored = keyed(cache.where("status = 'OK'")).select("_a", "_b", "event_date")
    return keyed(locs).join(stored, ["_a", "_b", "event_date"], "left_anti").drop("_a", "_b")


def within_budget(locs: DataFrame, budget: int, order: list[Column] | None = None) -> DataFrame:
    """The strongest locations a request budget allows."""
    return locs.orderBy(*(order or [F.desc("peak_frp"), F.col("recurrence_key")])).limit(budget)


def scene_ok(sample: Column, no_data: Column) -> Column:
    return (sample > 0) & ((sample - no_data) / sample >= C.MIN_VALID_FRACTION)


def burn_scars(locs: DataFrame, scenes: DataFrame, as_of: Column,
               key: str = "recurrence_key") -> DataFrame:
    """dNBR per location from scenes before and after its event.

    Scenes (key, scene_date, nbr_mean, sample_count, no_data_count) look up their location; the
    two windows are conditional averages of one aggregation.
    """
    dated = skew.lookup_join(scenes, locs.select(key, "event_date"), [key], "inner",
                             spread=F.col("scene_date"))
    gap = F.datediff("scene_date", "event_date")
    parsed = F.col("sample_count").isNotNull()
    clear = scene_ok(F.col("sample_count"), F.coalesce("no_data_count", F.lit(0))) \
        & F.col("nbr_mean").isNotNull()
    aggs = []
    for leg, (low, high) in {"pre": (-C.PRE_WINDOW_DAYS, -1),
                             "post": (1, C.POST_WINDOW_DAYS)}.items():
        inside = gap.between(low, high)
        aggs += [F.count_if(inside).alias(f"{leg}_scenes"),
                 F.count_if(inside & parsed).alias(f"{leg}_parsed"),
                 F.avg(F.when(inside & clear, F.col("nbr_mean"))).alias(f"nbr_{leg}")]
    legs = dated.groupBy(key).agg(*aggs)
    # both sides hold one row per location
    joined = locs.join(legs, key, "left")

    def leg_status(leg):
        return F.when(F.col(f"nbr_{leg}").isNotNull(), "OK") \
            .when(F.coalesce(f"{leg}_scenes", F.lit(0)) == 0, "NO_SCENES_IN_WINDOW") \
            .when(F.col(f"{leg}_parsed") == 0, "PARSE_MISMATCH").otherwise("NO_CLEAR_SCENE")

    waiting = F.datediff(as_of, "event_date") < C.MIN_DAYS_FOR_POST_SCENE
    status = F.when(waiting, "AWAITING_POST_SCENE") \
        .when(F.col("nbr_pre").isNull(), leg_status("pre")).otherwise(leg_status("post"))
    dnbr = F.when(status == "OK", half_up(F.col("nbr_pre") - F.col("nbr_post"), 4))
    return joined.select(
        *locs.columns, F.when(~waiting, F.col("nbr_pre")).alias("nbr_pre"),
        F.when(~waiting, F.col("nbr_post")).alias("nbr_post"), dnbr.alias("dnbr"),
        status.alias("status"), rules.burn_severity(dnbr).alias("severity"),
        rules.optical_verdict(dnbr).alias("verdict"))


def attach_scars(df: DataFrame, scars: DataFrame, key: str = "recurrence_key") -> DataFrame:
    """Every row of a location receives the location's answer."""
    side = scars.select(key, "dnbr", F.col("severity").alias("dnbr_severity"),
                        F.col("status").alias("dnbr_status"))
    joined = skew.lookup_join(df, side, [key], spread=F.col("detection_id"))
    return joined.select(*df.columns, "dnbr",
                         F.coalesce("dnbr_severity", F.lit("UNKNOWN")).alias("dnbr_severity"),
                         F.coalesce("dnbr_status", F.lit("NOT_REQUESTED")).alias("dnbr_status"))


def site_acquisitions(pixels: DataFrame, sites: DataFrame) -> DataFrame:
    """Hottest fire-channel day per site and the background of the same day.

    Pixels (site_id, day, latitude, longitude, f1, s7, valid) within the fire ring compete;
    pixels of the outer ring give the 25th percentile background.
    """
    located = skew.lookup_join(
        pixels, sites.select("site_id", F.col("latitude").alias("_lat"),
                             F.col("longitude").alias("_lon")), ["site_id"], "inner",
        spread=F.struct("day", "latitude", "longitude")).withColumn("km", geo.haversine_km(
            F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon")))
    fire = located.where((F.col("km") <= C.FIRE_RING_KM) & (F.col("valid") > 0)) \
        .groupBy("site_id", "day").agg(F.max("f1").alias("f1"), F.max("s7").alias("s7"),
                                       F.count(F.lit(1)).alias("samples"))
    hottest = fire.groupBy("site_id").agg(
        F.max_by(F.struct("day", "f1", "s7", "samples"), F.struct("f1", "day")).alias("b")) \
        .select("site_id", "b.*")
    low, high = C.BACKGROUND_RING_KM
    ring = located.where(F.col("km").between(low, high) & (F.col("valid") > 0))
    ground = exact_percentiles(ring, F.col("f1"), [0.25], ["background_k"], ["site_id", "day"])
    return hottest.join(ground, ["site_id", "day"], "left").select(
        "site_id", "day", "f1", "s7", "samples", "background_k",
        (F.col("f1") - F.col("s7")).alias("saturation_gap_k"),
        (F.col("f1") - F.col("background_k")).alias("excess_k"),
        F.when(F.col("background_k").isNull(), "NO_SCENE").otherwise("OK").alias("status"))
