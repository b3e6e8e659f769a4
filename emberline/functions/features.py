"""Model features as one projection over a joined, scored detection frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions.text import clip, column_or, confidence_percent, norm_bool, number_or

NUMERIC_FEATURES = (
    "frp", "bright_ti4", "bright_ti5", "temp_diff", "frp_density", "ti4_ratio",
    "detection_confidence", "dnbr", "onset_lag_days", "n_24h", "burst_ratio",
    "neighbourhood_active_keys", "dist_to_industrial_km", "n_30d", "mu_frp", "z_frp",
    "frp_ratio", "hour_utc", "month",
)
FLAG_FEATURES = ("dnbr_available", "inside_industrial", "is_exact_match", "in_forest",
                 "is_night", "is_harvest_season")
ONE_HOT_FEATURES = tuple(f"fac_{c}" for c in C.FACILITY_CATEGORIES)
FEATURES = NUMERIC_FEATURES + FLAG_FEATURES + ONE_HOT_FEATURES


def feature_columns(df: DataFrame) -> dict[str, Column]:
    """Feature name -> expression; absent inputs take their documented defaults."""
    def num(name, default, low=None, high=None):
        return clip(number_or(column_or(df, name), default), low, high)

    def flag(name):
        return norm_bool(column_or(df, name)).cast("int")

    ts = column_or(df, "timestamp_utc").cast("timestamp")
    frp = num("frp", 0.0, low=0.0)
    ti4, ti5 = num("bright_ti4", 300.0), num("bright_ti5", 290.0)
    scan, track = num("scan", 0.4, low=0.1), num("track", 0.4, low=0.1)
    month = F.coalesce(F.month(ts), F.lit(9))
    raw_dnbr = column_or(df, "dnbr").try_cast("double")
    dnbr = clip(F.nanvl(raw_dnbr, F.lit(None).cast("double")), -1.0, 2.0)
    kind = F.coalesce(column_or(df, "facility_type").cast("string"), F.lit("non_industrial"))
    cols = {
        "frp": frp, "bright_ti4": ti4, "bright_ti5": ti5, "temp_diff": ti4 - ti5,
        "frp_density": frp / (scan * track), "ti4_ratio": ti4 / (ti5 + 1e-4),
        "detection_confidence": confidence_percent(column_or(df, "confidence")),
        "dnbr": dnbr, "dnbr_available": dnbr.isNotNull().cast("int"),
        "onset_lag_days": num("onset_lag_days", -1.0), "n_24h": num("n_24h", 0.0),
        "burst_ratio": num("burst_ratio", 0.0),
        "neighbourhood_active_keys": num("neighbourhood_active_keys", 0.0),
        "inside_industrial": flag("inside_industrial"),
        "is_exact_match": flag("is_exact_match"), "in_forest": flag("in_forest"),
        "dist_to_industrial_km": num("dist_to_industrial_km", C.NO_POLYGON_KM, 0.0, 100.0),
        "n_30d": num("n_30d", 0.0).cast("int"), "mu_frp": num("mu_frp", 0.0),
        "z_frp": num("z_frp", 0.0, -5.0, 20.0), "frp_ratio": num("frp_ratio", 1.0, 0.0, 50.0),
        "is_night": (F.upper(F.coalesce(column_or(df, "daynight").cast("string"), F.lit("D")))
                     == "N").cast("int"),
        "hour_utc": F.coalesce(F.hour(ts), F.lit(12)), "month": month,
        "is_harvest_season": month.isin(*C.HARVEST_MONTHS).cast("int"),
        "facility_type": kind,
    }
    for category in C.FACILITY_CATEGORIES:
        cols[f"fac_{category}"] = (kind == category).cast("int")
    return cols


def with_features(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    cols = feature_columns(df)
    return df.select(*keep, *[cols[f].alias(f) for f in FEATURES if f not in keep],
                     *([] if "facility_type" in keep else [cols["facility_type"]
                                                           .alias("facility_type")]))
