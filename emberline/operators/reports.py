"""Aggregate reports over scored detections: cells, facilities, key figures, charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions import grid, rules
from emberline.functions.text import column_or, half_up, norm_bool, norm_str, number_or


def exact_sum(value: Column) -> Column:
    """Sum that does not depend on the order of its parts (four decimals kept)."""
    return F.sum(value.cast("decimal(18,4)")).cast("double")


def observed_day(df: DataFrame) -> Column:
    return F.coalesce(column_or(df, "acq_date").try_cast("date"),
                      column_or(df, "timestamp_utc").cast("date"))


def filter_map(df: DataFrame, bbox: Sequence[float] | None = None,
               states: Sequence[str] | None = None) -> DataFrame:
    """(west, south, east, north) box, inclusive, and a case-insensitive state list."""
    if bbox is not None:
        west, south, east, north = (float(v) for v in bbox)
        df = df.where(F.col("latitude").between(south, north)
                      & F.col("longitude").between(west, east))
    if states:
        df = df.where(F.upper("state").isin(*[s.upper() for s in states]))
    return df


def cell_report(df: DataFrame, resolution: int = 6, bbox: Sequence[float] | None = None,
                states: Sequence[str] | None = None, min_detections: int = 1,
                limit: int | None = None) -> DataFrame:
    """Detections rolled up to map cells, most urgent first, in a single aggregation.

    Every aggregate combines map-side, and its buffer holds at most the distinct days, powers
    (two decimals) and names of a cell, so a cell with most of the rows is no bottleneck.
    """
    zoom_res = min(max(resolution, C.MIN_MAP_RESOLUTION), C.MAX_MAP_RESOLUTION)
    stored = grid.roll_up(F.col("cell"), zoom_res) if "cell" in df.columns \
        else grid.cell_at("latitude", "longitude", zoom_res)
    rows = filter_map(df, bbox, states).select(
        stored.alias("cell"), observed_day(df).alias("day"),
        number_or(column_or(df, "frp"), 0.0).alias("frp"),
        F.coalesce(column_or(df, "priority").cast("string"), F.lit("NON_ALERT")).alias("priority"),
        F.coalesce(column_or(df, "state").cast("string"), F.lit("UNKNOWN")).alias("state"),
        norm_bool(column_or(df, "suppressed")).alias("suppressed")).where("cell IS NOT NULL")
    rank = rules.priority_rank(F.col("priority"))
    stats = rows.groupBy("cell").agg(
        F.count(F.lit(1)).alias("detections"), F.countDistinct("day").alias("days_observed"),
        F.max("frp").alias("frp_max_mw"), F.median("frp").alias("frp_median_mw"),
        exact_sum(F.col("frp")).alias("frp_total_mw"),
        F.count_if(F.col("priority") == "P0_EMERGENCY").alias("p0"),
        F.count_if(F.col("priority") == "P1_ALERT").alias("p1"),
        F.count_if("suppressed").alias("suppressed"),
        F.min(rank).alias("top_rank"),
        # ties: the more urgent priority, the state whose name sorts first
        F.mode(F.concat(rank.cast("string"), F.col("priority")), True).alias("_priority"),
        F.mode("state", True).alias("dominant_state"))
    report = (stats.where(F.col("detections") >= max(1, min_detections))
              .withColumn("dominant_priority", F.expr("substring(_priority, 2)"))
              .select("cell", F.lit(C.ZOOM_BY_RESOLUTION[zoom_res]).alias("zoom"), "detections",
                      "days_observed", half_up(F.col("frp_max_mw"), 2).alias("frp_max_mw"),
                      half_up(F.col("frp_median_mw"), 2).alias("frp_median_mw"),
                      half_up(F.col("frp_total_mw"), 1).alias("frp_total_mw"), "p0", "p1",
                      "suppressed", "top_rank",
                      rules.priority_name(F.col("top_rank")).alias("top_priority"),
                      "dominant_priority", "dominant_state"))
    ordered = report.orderBy("top_rank", F.desc("detections"), "cell")
    return ordered if limit is None else ordered.limit(max(limit, 1))


def cell_summary(df: DataFrame, cells: DataFrame, returned: DataFrame,
                 resolution: int = 6) -> DataFrame:
    """One row about a cell report: coverage, truncation, compression."""
    every = cells.agg(F.count(F.lit(1)).alias("cells_total"),
                      F.sum("detections").alias("detections_aggregated"))
    total = df.agg(F.count(F.lit(1))).scalar()
    shown = returned.agg(F.count(F.lit(1))).scalar()
    return every.select(
        F.lit(resolution).alias("resolution"), F.lit(grid.GRID_NAME).alias("grid"),
        grid.edge_km(resolution).alias("approx_cell_edge_km"), "detections_aggregated",
        total.alias("detections_in_corpus"), shown.alias("cells_returned"),
        (F.col("cells_total") > shown).alias("truncated"),
        half_up(F.col("detections_aggregated") / F.greatest(shown, F.lit(1)), 1)
        .alias("compression_ratio"))


def register_key(df: DataFrame) -> tuple[Column, Column]:
    """Facility identity (polygon, else name, else source key) and its display name."""
    osm, name = norm_str(column_or(df, "osm_id")), norm_str(column_or(df, "facility_name"))
    key = F.coalesce(F.concat(F.lit("osm:"), osm), F.concat(F.lit("name:"), name),
                     F.concat(F.lit("key:"), F.coalesce(
                         norm_str(column_or(df, "recurrence_key")), F.lit(""))))
    display = F.coalesce(name, F.concat(F.lit("OSM way "), osm), F.lit("unmapped source"))
    return key, display


def routine(df: DataFrame) -> DataFrame:
    missing = {"state", "frp", "latitude", "longitude"} - set(df.columns)
    if missing:
        raise KeyError(f"register needs columns {sorted(missing)}")
    kind = F.lower(F.trim(column_or(df, "facility_type").cast("string")))
    return df.where(F.col("state").isin(*C.ROUTINE_STATES)
                    & ~F.coalesce(kind.isin(*C.NON_EMITTING_TYPES), F.lit(False)))


def facility_register(df: DataFrame, min_detections: int = 10,
                      limit: int | None = None) -> DataFrame:
    """Routine thermal activity per facility, largest total power first."""
    rows = routine(df)
    key, display = register_key(rows)
    day = observed_day(rows)
    span_days = rows.agg(F.greatest(F.datediff(F.max(day), F.min(day)), F.lit(1))).scalar()
    frp = number_or(F.col("frp"), 0.0)
    first = F.struct(F.col("us") if "us" in df.columns else F.unix_micros("timestamp_utc"),
                     F.col("detection_id")) if "detection_id" in df.columns else day
    stats = rows.groupBy(key.alias("register_key")).agg(
        F.min_by(display, first).alias("facility_name"),
        F.min_by(F.coalesce(column_or(rows, "facility_type"), F.lit("unknown")), first)
        .alias("facility_type"),
        F.median("latitude").alias("latitude"), F.median("longitude").alias("longitude"),
        F.count(F.lit(1)).alias("detections"), F.countDistinct(day).alias("days_observed"),
        F.median(frp).alias("frp_median_mw"), F.max(frp).alias("frp_max_mw"),
        exact_sum(frp).alias("frp_total_mw"),
        F.count_if(norm_bool(column_or(rows, "suppressed"))).alias("suppressed_from_dispatch"))
    ratio = F.col("days_observed") / F.col("span_days")
    out = (stats.where(F.col("detections") >= min_detections).withColumn("span_days", span_days)
           .select("register_key", "facility_name", "facility_type", "latitude", "longitude",
                   "detections", "days_observed", "span_days",
                   half_up(ratio, 4).alias("observation_ratio"),
                   F.when(ratio >= C.CONTINUOUS_RATIO, "CONTINUOUS").otherwise("INTERMITTENT")
                   .alias("regime"),
                   half_up(F.col("frp_median_mw"), 2).alias("frp_median_mw"),
                   half_up(F.col("frp_max_mw"), 2).alias("frp_max_mw"),
                   half_up(F.col("frp_total_mw"), 1).alias("frp_total_mw"),
                   half_up(F.col("frp_total_mw") * C.HOURS_PER_DETECTION * 3.6, 1)
                   .alias("estimated_fre_gj"), "suppressed_from_dispatch"))
    if limit is None:
        return out
    return out.orderBy(F.desc("frp_total_mw"), "register_key").limit(limit)


def register_summary(register: DataFrame, df: DataFrame) -> DataFrame:
    """Counts over the listed entries (after any limit) and the routine rows behind them."""
    n = routine(df).agg(F.count(F.lit(1))).scalar()
    return register.agg(
        F.count(F.lit(1)).alias("sites_listed"),
        F.count_if(F.col("regime") == "CONTINUOUS").alias("sites_continuous")) \
        .withColumn("routine_detections", n) \
        .withColumn("status", F.when(n > 0, "OK").otherwise("NO_ROUTINE_DETECTIONS"))


def key_figures(df: DataFrame) -> DataFrame:
    """Counts by urgency and the share kept away from an operator."""
    p = F.col("priority")
    total = F.count(F.lit(1))
    urgent = F.count_if(p.isin("P0_EMERGENCY", "P1_ALERT"))
    return df.agg(
        total.alias("total_detections"),
        F.count_if(p == "P0_EMERGENCY").alias("p0_emergencies"),
        F.count_if(p == "P1_ALERT").alias("p1_alerts"),
        F.count_if(p == "P2_ADVISORY").alias("p2_advisories"),
        (total - urgent).alias("suppressed"),
        F.when(total > 0, half_up((total - urgent) / total * 100.0, 2)).otherwise(100.0)
        .alias("fatigue_reduction_pct"),
        F.count_if(norm_bool("inside_industrial")).alias("industrial_incidents"))


def breakdown(df: DataFrame, *dimensions: str) -> DataFrame:
    """Counts per value of several dimensions in one pass."""
    shaped = df.select(*[F.coalesce(F.col(d).cast("string"), F.lit("UNKNOWN")).alias(d)
                         for d in dimensions])
    counts = shaped.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"))
                                for d in dimensions]))
    return counts.select("_n", pairs.alias("p")).groupBy(
        F.col("p.dimension").alias("dimension"), F.col("p.value").alias("value")) \
        .agg(F.sum("_n").alias("n"))


def chart_counts(df: DataFrame) -> DataFrame:
    """FRP histogram and type / priority / state counts."""
    shaped = df.select(
        rules.frp_bin(F.col("frp")).alias("frp_bin"),
        F.coalesce("facility_type", F.lit("non_industrial")).alias("facility_type"),
        F.coalesce("priority", F.lit("NON_ALERT")).alias("priority"),
        F.coalesce("state", F.lit("TRANSIENT_SUSPICION")).alias("state"))
    return breakdown(shaped, "frp_bin", "facility_type", "priority", "state")


def hottest(df: DataFrame, n: int = 10) -> DataFrame:
    return df.select("detection_id",
                     F.coalesce("facility_name", F.lit("Unnamed Site")).alias("facility_name"),
                     "facility_type", "latitude", "longitude", "frp", "priority") \
        .orderBy(F.desc("frp"), "detection_id").limit(n)


def active_incidents(df: DataFrame, priority: str | None = None, industrial_only: bool = False,
                     status: str | None = None, limit: int = 500) -> DataFrame:
    """Operator list: inside first, then power, then recency."""
    if priority:
        df = df.where(F.col("priority") == priority)
    if industrial_only:
        df = df.where(norm_bool("inside_industrial"))
    if status:
        df = df.where(F.col("status") == status)
    return df.orderBy(F.desc(norm_bool("inside_industrial")), F.desc("frp"),
                      F.desc("timestamp_utc"), "detection_id") \
        .limit(limit)


def freshness(df: DataFrame, as_of: str) -> DataFrame:
    newest = F.max(F.col("timestamp_utc").cast("timestamp"))
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(newest)) / C.HOUR_US
    return df.agg(newest.alias("newest"), half_up(age, 3).alias("age_hours"),
                  rules.freshness(age).alias("badge"))


def optical_coverage(df: DataFrame) -> DataFrame:
    """Counts by optical status, severity and verdict; unmeasured stays unmeasured."""
    return df.groupBy("status", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count("dnbr").alias("measured"),
        F.count_if(F.col("dnbr").isNull()).alias("unmeasured"))


def optical_points(df: DataFrame, limit: int, key: str = "recurrence_key") -> DataFrame:
    """The first points of a map layer, each saying whether more were left out."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(key).limit(limit).withColumn("truncated", total > F.lit(limit))


def corpus_span(df: DataFrame) -> DataFrame:
    """Distinct days of a corpus and whether they are enough for thirty-day thresholds."""
    days = F.countDistinct(observed_day(df))
    return df.agg(days.alias("days"), (days < C.MIN_CORPUS_DAYS).alias("too_short"))


def layer_summary(df: DataFrame, kind: str = "responder_kind") -> DataFrame:
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def health(**tables: DataFrame) -> DataFrame:
    """Row counts of the serving tables, one row per table."""
    parts = [t.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
             for name, t in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
