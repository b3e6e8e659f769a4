"""Thirty-day history of every source, activity of its surroundings, and alert state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions import grid, rules
from emberline.functions.text import half_up, norm_bool, norm_str, number_or
from emberline.operators import running as R
from emberline.operators import skew

# FRP is summed as whole 1e-4 MW, so adding and removing readings is exact.
_UNIT = 10_000
_HI = 1 << 20


@dataclass(frozen=True)
class RecurrenceConfig:
    window_days: int = C.WINDOW_DAYS
    burst_hours: int = C.BURST_HOURS
    persistence_min: int = C.PERSISTENCE_MIN
    hot_min_rows: int = skew.HOT_MIN_ROWS
    chunk_us: int = R.HOT_CHUNK_US
    chunk_rows: int = R.CHUNK_ROWS
    name_before_polygon: bool = False


def recurrence_key(inside: Column, ids: list[Column], cell: Column) -> Column:
    """fac:<id> inside a site with a usable id, else hex:<cell>."""
    site = F.coalesce(*[norm_str(c) for c in ids]) if ids else F.lit(None).cast("string")
    return F.when(norm_bool(inside) & site.isNotNull(), F.concat(F.lit("fac:"), site)) \
        .otherwise(F.concat(F.lit("hex:"), cell.cast("string")))


def with_keys(df: DataFrame, id_cols: tuple[str, ...] = ("osm_id", "poly_id", "facility_name")
              ) -> DataFrame:
    """Event time in microseconds, the three cells and the recurrence key."""
    ids = [F.col(c) for c in id_cols if c in df.columns]
    inside = F.col("inside_industrial") if "inside_industrial" in df.columns else F.lit(False)
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.withColumns({
        "us": F.unix_micros(F.col("timestamp_utc").cast("timestamp")),
        "cell": grid.cell_at(lat, lon, 9),
        "area": grid.cell_at(lat, lon, 6),
        "recurrence_key": recurrence_key(inside, ids, grid.cell_at(lat, lon, 8)),
    })


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): rows without an instant or a position cannot be ordered or placed."""
    ok = (F.col("timestamp_utc").isNotNull() & F.col("latitude").isNotNull()
          & F.col("longitude").isNotNull())
    return df.where(ok), df.where(~ok)


def source_history(df: DataFrame, cfg: RecurrenceConfig = RecurrenceConfig(),
                   corpus_start: Column | None = None) -> DataFrame:
    """Prior 30-day count, mean and variance, source age, onset lag and 24-hour burst.

    Every detection enters the running totals at its own time and leaves them one microsecond
    after its window ends; the value just before a detection is its trailing window.
    """
    window_us, burst_us = cfg.window_days * C.DAY_US, cfg.burst_hours * C.HOUR_US
    key = ["recurrence_key"]
    hot = skew.hot_keys(df, key, cfg.hot_min_rows)
    frp = number_or("frp", 0.0)
    q = F.floor(frp * _UNIT + 0.5).cast("long")
    none = F.lit(None).cast(df.select(F.struct("*").alias("r")).schema["r"].dataType)

    def event(time, order, row, n30, n24):
        return F.struct(time.alias("t"), F.lit(order).alias("ord"), row.alias("row"),
                        F.lit(n30).cast("long").alias("d30"), F.lit(n24).cast("long").alias("d24"))

    us = F.col("us")
    packed = F.struct(*[F.col(c) for c in df.columns])
    events = df.select(
        "recurrence_key", F.col("detection_id").alias("id"), q.alias("q"),
        F.explode(F.array(
            event(us, 1, packed, 1, 1),
            event(us + window_us + 1, 0, none, -1, 0),
            event(us + burst_us + 1, 0, none, 0, -1))).alias("e"),
    ).select("recurrence_key", "id", "q", "e.*")
    d30, square = F.col("d30"), F.col("q") * F.col("q")
    order = [F.col("t"), F.col("ord"), F.col("id")]
    is_row = F.col("ord") == 1
    totals = {
        "n_prev": ("sum", d30),
        "s1": ("sum", d30 * F.col("q")),
        "s2_hi": ("sum", d30 * F.floor(square / _HI).cast("long")),
        "s2_lo": ("sum", d30 * (square % _HI)),
        "n24_prev": ("sum", F.col("d24")),
        "first_us": ("min", F.when(is_row, F.col("t"))),
    }
    cuts = None
    if hot is not None:
        times = df.join(hot, key, "left_semi").select(*key, F.explode(F.array(
            us, us + window_us + 1, us + burst_us + 1)).alias("t"))
        cuts = R.cut_points(times, key, "t", cfg.chunk_us, cfg.chunk_rows)
    prepared = R.chunked(events, key, "t", hot, cfg.chunk_us, cuts)
    seen = R.running(prepared, key, order, totals, hot).where(is_row)
    persistent_at = F.when(F.col("n_prev") >= cfg.persistence_min, F.col("t"))
    seen = R.running(seen, key, order, {"persistent_us": ("min", persistent_at)}, hot,
                     include_current=True)
    start = df.agg(F.min("us")).scalar() if corpus_start is None else corpus_start

    n = F.col("n_prev")
    mean = F.col("s1").cast("double") / n / _UNIT
    mean_sq = (F.col("s2_hi").cast("double") * _HI + F.col("s2_lo").cast("double")) \
        / n / float(_UNIT * _UNIT)
    row_frp = number_or("row.frp", 0.0)
    n24, prior_days = F.col("n24_prev") + 1, float(max(cfg.window_days - cfg.burst_hours / 24, 1))
    prior_rate = (n + 1 - n24).cast("double") / prior_days
    days = float(C.DAY_US)
    return seen.select(
        "row.*",
        n.cast("int").alias("n_30d"),
        F.when(n > 0, mean).otherwise(row_frp).alias("mu_raw"),
        F.when(n > 1, F.greatest(mean_sq - mean * mean, F.lit(0.0)))
        .otherwise(F.lit(1.0)).alias("var_raw"),
        F.coalesce((F.col("t") - F.col("first_us")) / days, F.lit(0.0)).alias("source_age_days"),
        F.when(F.col("persistent_us").isNotNull(),
               F.greatest((F.col("persistent_us") - start) / days, F.lit(0.0)))
        .otherwise(F.lit(-1.0))
        .alias("onset_lag_days"),
        n24.cast("int").alias("n_24h"),
        F.when(prior_rate > 0, n24 / (cfg.burst_hours / 24.0) / prior_rate)
        .otherwise(F.lit(0.0)).alias("burst_raw"),
    )


def activity_intervals(df: DataFrame, window_days: int = C.WINDOW_DAYS) -> DataFrame:
    """Stretches in which a source counts as active in an area.

    Readings are first folded to one row per source, area and day. A gap longer than the window
    starts a new stretch, which ends one window after its last reading.
    """
    window_us = window_days * C.DAY_US
    daily = (df.groupBy("area", "recurrence_key", F.floor(F.col("us") / C.DAY_US).alias("day"))
             .agg(F.min(F.struct("us", "detection_id")).alias("first"),
                  F.max("us").alias("last_us")))
    by_day = Window.partitionBy("area", "recurrence_key").orderBy("day")
    stretch = F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > window_us), 1).otherwise(0))
    return (daily.withColumn("gap", F.col("first.us") - F.lag("last_us").over(by_day))
            .withColumn("stretch", stretch.over(by_day))
            .groupBy("area", "recurrence_key", "stretch")
            .agg(F.min("first").alias("first"), F.max("last_us").alias("last_us"))
            .select("area", "recurrence_key", F.col("first.us").alias("start_us"),
                    F.col("first.detection_id").alias("start_id"),
                    (F.col("last_us") + window_us).alias("end_us")))


def neighbourhood(df: DataFrame, cfg: RecurrenceConfig = RecurrenceConfig(),
                  keyed: DataFrame | None = None) -> DataFrame:
    """Distinct other sources active nearby just before each detection.

    ``keyed`` may give the same detections from an earlier, cheaper point of the plan.
    +1 where a stretch starts, -1 after it ends; the running total at a detection counts its own
    source exactly once, hence the final minus one.
    """
    keyed = df if keyed is None else keyed
    hot = skew.hot_keys(keyed, ["area"], cfg.hot_min_rows)
    none = F.lit(None).cast(df.select(F.struct("*").alias("r")).schema["r"].dataType)
    edges = activity_intervals(keyed, cfg.window_days).select("area", F.explode(F.array(
        F.struct(F.col("start_us").alias("t"), F.lit(1).alias("ord"),
                 F.col("start_id").alias("id"), F.lit(0).alias("kind"), F.lit(1).alias("d")),
        F.struct((F.col("end_us") + 1).alias("t"), F.lit(0).alias("ord"),
                 F.col("start_id").alias("id"), F.lit(0).alias("kind"), F.lit(-1).alias("d")),
    )).alias("e")).select("area", "e.*", none.alias("row"))
    probes = df.select("area", F.col("us").alias("t"), F.lit(1).alias("ord"),
                       F.col("detection_id").alias("id"), F.lit(1).alias("kind"),
                       F.lit(0).alias("d"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    cuts = slim = None
    if hot is not None:
        # boundary events and neutral probe rows without payload, for cut points and prefix
        narrow = edges.select("area", "t", "d").unionByName(
            keyed.select("area", F.col("us").alias("t"), F.lit(0).alias("d"))).join(hot, "area", "left_semi")
        cuts = R.cut_points(narrow, ["area"], "t", cfg.chunk_us, cfg.chunk_rows)
        slim = R.chunked(narrow, ["area"], "t", hot, cfg.chunk_us, cuts)
    events = R.chunked(edges.unionByName(probes), ["area"], "t", hot, cfg.chunk_us, cuts)
    order = [F.col(c) for c in ("t", "ord", "id", "kind")]
    counted = R.running(events, ["area"], order, {"active": ("sum", F.col("d"))}, hot,
                        contributors=slim)
    return counted.where(F.col("kind") == 1).select(
        "row.*", (F.col("active") - 1).cast("int").alias("neighbourhood_active_keys"))


def with_alert_state(df: DataFrame) -> DataFrame:
    """Decide on unrounded history, then publish rounded figures beside the raw FRP."""
    frp = number_or("frp", 0.0)
    mu, var = F.col("mu_raw"), F.col("var_raw")
    inside = norm_bool(F.col("inside_industrial")) if "inside_industrial" in df.columns \
        else F.lit(False)
    decided = df.withColumn("_d", rules.alert_decision(F.col("n_30d"), frp, mu, var, inside))
    keep = [c for c in df.columns if c not in ("frp", "mu_raw", "var_raw", "burst_raw")]
    return decided.select(
        *keep, frp.alias("frp_raw"), half_up(frp, 2).alias("frp"), half_up(mu, 2).alias("mu_frp"),
        half_up(var, 2).alias("var_frp"), half_up(rules.z_score(frp, mu, var), 2).alias("z_frp"),
        half_up(rules.frp_ratio(frp, mu), 2).alias("frp_ratio"),
        half_up(F.col("burst_raw"), 3).alias("burst_ratio"), "_d.*")


def evaluate(df: DataFrame, cfg: RecurrenceConfig = RecurrenceConfig(),
             neighbours: bool = True, corpus_start: Column | None = None) -> DataFrame:
    """Keys, history, neighbourhood and alert state of a detection frame.

    ``corpus_start`` overrides the first instant when the frame is part of a longer corpus.
    """
    ids = ("osm_id", "facility_name", "poly_id") if cfg.name_before_polygon \
        else ("osm_id", "poly_id", "facility_name")
    keyed = df if "recurrence_key" in df.columns else with_keys(df, ids)
    history = source_history(keyed, cfg, corpus_start)
    if neighbours:
        history = neighbourhood(history, cfg, keyed)
    return with_alert_state(history)
