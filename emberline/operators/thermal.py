"""Sub-pixel fire temperature per instrument. Experimental: it does not separate fuel regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions import physics, rules
from emberline.functions.text import column_or, half_up, number_or
from emberline.operators.labels import detection_month
from emberline.operators.quantiles import exact_percentiles

DEFAULT_BACKGROUND_K = 290.0


def strata(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "instrument": F.upper(F.coalesce("instrument", F.lit("VIIRS"))),
        "_month": F.coalesce(detection_month(df), F.lit(0)),
        "_dn": F.upper(F.coalesce(column_or(df, "daynight").cast("string"), F.lit("D")))})


def background_temperature(df: DataFrame, tir_col: str = "bright_ti5",
                           pct: float = 0.10) -> DataFrame:
    """Low percentile of the thermal band per instrument, month and day/night, kept in 250-330."""
    value = F.nanvl(F.col(tir_col).cast("double"), F.lit(None).cast("double"))
    by_stratum = exact_percentiles(strata(df), value, [pct], ["bg"],
                                   ["instrument", "_month", "_dn"])
    return by_stratum.select("instrument", F.col("_month").alias("month"),
                             F.col("_dn").alias("daynight"), "n",
                             F.least(F.greatest("bg", F.lit(250.0)), F.lit(330.0))
                             .alias("background_k"))


def add_fire_temperature(df: DataFrame, mwir: str = "bright_ti4",
                         tir: str = "bright_ti5") -> DataFrame:
    rows = strata(df)
    grounds = background_temperature(df, tir).select(
        "instrument", F.col("month").alias("_month"), F.col("daynight").alias("_dn"),
        "background_k")
    # instruments x 13 months x day/night rows
    joined = rows.join(F.broadcast(grounds), ["instrument", "_month", "_dn"], "left") \
        .withColumn("background_k", F.coalesce("background_k", F.lit(DEFAULT_BACKGROUND_K)))
    sat, lam_m, lam_t = (F.lit(None).cast("double") for _ in range(3))
    for name, (a, b) in C.BANDS_UM.items():
        is_it = F.col("instrument") == name
        lam_m, lam_t = F.when(is_it, a).otherwise(lam_m), F.when(is_it, b).otherwise(lam_t)
        if name in C.SATURATION_K:
            sat = F.when(is_it, C.SATURATION_K[name]).otherwise(sat)
    hot, cool = F.col(mwir).cast("double"), F.col(tir).cast("double")
    saturated = F.coalesce(hot >= sat, F.lit(False))
    solvable = (hot > F.col("background_k") + 2.0) & cool.isNotNull() & ~saturated & sat.isNotNull()
    solved = joined.withColumn("_solvable", F.coalesce(solvable, F.lit(False))).withColumn(
        "_s", physics.fire_temperature(
            F.when(F.col("_solvable"), hot), cool, F.col("background_k"), lam_m, lam_t))
    t, area = F.col("_s.t_fire_k"), F.col("_s.area_fraction")
    pixel = number_or(column_or(df, "scan"), 0.375) * number_or(column_or(df, "track"), 0.375)
    return solved.select(
        *df.columns, "background_k", half_up(t, 1).alias("t_fire_k"),
        area.alias("fire_area_fraction"), half_up(area * pixel * 1e6, 1).alias("fire_area_m2"),
        rules.combustion_regime(t).alias("combustion_regime"),
        F.when(t.isNotNull() & (area > 1e-4), "HIGH").when(t.isNotNull(), "MODERATE")
        .when(saturated, "SATURATED").otherwise("FAILED").alias("t_fire_confidence"))
