"""Per-incident dossier: baseline, weather of the hour, latest audit rows, plume and emissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import geo, rules
from emberline.functions.text import half_up
from emberline.operators import skew
from emberline.operators.incidents import recurrence_evidence


def hourly_value(values: Column, hour: Column) -> Column:
    """Reading of an hour (the last one for short days), else the day's first reading."""
    index = F.least(hour, F.size(values) - 1)
    present = F.filter(values, lambda v: v.isNotNull())
    return F.coalesce(F.get(values, index), F.get(present, F.lit(0)))


def attach_weather(df: DataFrame, weather: DataFrame,
                   fields: tuple[str, ...] = ("temperature_2m", "wind_speed_10m")) -> DataFrame:
    """Weather at the incident's place and hour from parallel hourly arrays; absent stays NULL."""
    keyed = df.withColumns({
        "_wlat": half_up(F.col("latitude"), 3), "_wlon": half_up(F.col("longitude"), 3),
        "_wday": F.to_date("timestamp_utc")})
    docs = weather.select(
        half_up(F.col("latitude"), 3).alias("_wlat"), half_up(F.col("longitude"), 3).alias("_wlon"),
        F.col("day").alias("_wday"), F.lit(True).alias("_found"), *fields)
    hour = F.hour("timestamp_utc")
    joined = skew.lookup_join(keyed, docs, ["_wlat", "_wlon", "_wday"],
                              spread=F.col("detection_id"))
    return joined.select(
        *df.columns, *[hourly_value(F.col(f), hour).alias(f) for f in fields],
        F.coalesce("_found", F.lit(False)).alias("weather_is_measured"))


def latest_audit(audit: DataFrame, k: int = 10) -> DataFrame:
    """Newest k audit rows per detection as one short array."""
    newest = skew.top_k(audit, ["detection_id"], [F.desc("at"), F.desc("seq")], k, F.col("seq"))
    return newest.groupBy("detection_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "at", "action"))),
        lambda a: F.struct(a["at"].alias("at"), a["action"].alias("action"))).alias("audit"))


def dossier(incidents: DataFrame, weather: DataFrame, audit: DataFrame, baselines: DataFrame) -> DataFrame:
    """Everything a duty officer reads about an incident, with what its cell normally does."""
    rows = attach_weather(recurrence_evidence(incidents, baselines), weather)
    notes = latest_audit(audit)
    frp = F.col("frp")
    grid_ref = geo.utm(F.col("latitude"), F.col("longitude"))
    return rows.join(notes, "detection_id", "left").withColumns({
        "frp_severity": rules.frp_severity(frp), "hazard_km": geo.hazard_km(frp),
        "evacuation_km": geo.evacuation_km(frp), "utm": grid_ref,
        "emissions": rules.emissions(frp, F.col("facility_type")),
        "audit_rows": F.coalesce(F.size("audit"), F.lit(0))})
