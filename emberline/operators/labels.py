"""Percentile thresholds, weak labels, balanced training corpus, splits and prior correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions import rules
from emberline.functions.text import column_or, norm_bool, number_or
from emberline.operators.quantiles import exact_percentiles


def frp_thresholds(df: DataFrame, min_samples: int = C.MIN_PERCENTILE_SAMPLES) -> DataFrame:
    """One row: four energy gates from positive FRP outside polygons, or the fixed fallback."""
    frp = column_or(df, "frp").try_cast("double")
    outside = df.where((frp > 0) & ~F.isnan(frp) & ~norm_bool(column_or(df, "inside_industrial")))
    local = exact_percentiles(outside, frp, C.THRESHOLD_PCTS, C.THRESHOLD_NAMES)
    enough = F.col("n") >= min_samples
    return local.select(
        *[F.when(enough, F.col(name)).otherwise(C.DEFAULT_THRESHOLDS[name]).alias(name)
          for name in C.THRESHOLD_NAMES],
        F.when(enough, "PERCENTILE_LOCAL").otherwise("ABSOLUTE_FALLBACK").alias("basis"),
        F.when(enough, F.col("n")).otherwise(0).alias("n_samples"))


def detection_month(df: DataFrame) -> Column:
    """Month of the acquisition date, else of the timestamp."""
    day = column_or(df, "acq_date").try_cast("date")
    return F.coalesce(F.month(day), F.month(column_or(df, "timestamp_utc").cast("timestamp")))


def label_column(df: DataFrame, gates: dict[str, Column]) -> Column:
    """The labelling rule over a frame, with missing inputs filled the way training fills them."""
    lat = column_or(df, "latitude").try_cast("double")
    lon = column_or(df, "longitude").try_cast("double")
    return rules.weak_label(
        facility_type=F.coalesce(column_or(df, "facility_type").cast("string"), F.lit("")),
        inside=norm_bool(column_or(df, "inside_industrial")),
        frp=number_or(column_or(df, "frp"), 0.0), n30=number_or(column_or(df, "n_30d"), 0.0),
        z=number_or(column_or(df, "z_frp"), 0.0),
        onset=number_or(column_or(df, "onset_lag_days"), -1.0),
        n24=number_or(column_or(df, "n_24h"), 0.0),
        burst_ratio=number_or(column_or(df, "burst_ratio"), 0.0),
        neighbours=number_or(column_or(df, "neighbourhood_active_keys"), 0.0),
        in_forest=norm_bool(column_or(df, "in_forest")), month=detection_month(df),
        in_domain=rules.in_season_domain(lat, lon), thresholds=gates)


def fixed_gates() -> dict[str, Column]:
    return {k: F.lit(v) for k, v in C.DEFAULT_THRESHOLDS.items()}


def with_weak_label(df: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Add ``target_label``; thresholds come from a one-row frame as one scalar subquery."""
    if thresholds is None:
        return df.withColumn("target_label", label_column(df, fixed_gates()))
    row = thresholds.select(F.struct(*C.THRESHOLD_NAMES)).scalar()
    gates = {n: F.col(f"_gates.{n}") for n in C.THRESHOLD_NAMES}
    return df.withColumn("_gates", row).withColumn("target_label", label_column(df, gates)) \
        .drop("_gates")


def training_corpus(df: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Labelled rows that have coordinates, tagged as rule-labelled real data."""
    placed = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    gates = frp_thresholds(placed) if thresholds is None else thresholds
    return with_weak_label(placed, gates).withColumn("label_source", F.lit("heuristic_real"))


def class_counts(df: DataFrame, label: str = "target_label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def balance(df: DataFrame, ratio_cap: int = 50, seed: int = 42,
            id_col: str = "detection_id") -> DataFrame:
    """Cut classes above ratio_cap x the smallest one, keeping every month's share.

    The draw order is md5(id, seed). A class and month may hold most rows, so its rank is built
    from per-prefix counts: rank inside a 3-digit hash prefix plus the rows of smaller prefixes.
    """
    label = "target_label"
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    stratum = F.coalesce(detection_month(df), F.lit(0))
    drawn = df.withColumns({"_m": stratum, "_h": digest}) \
        .withColumn("_p", F.substring("_h", 1, 3))
    cells = drawn.groupBy(label, "_m", "_p").agg(F.count(F.lit(1)).alias("_c"))
    per_class = class_counts(df)
    smallest = per_class.agg(F.min("n")).scalar()
    in_stratum = Window.partitionBy(label, "_m")
    plan = (cells.select(
        label, "_m", "_p",
        F.coalesce(F.sum("_c").over(in_stratum.orderBy("_p").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(in_stratum).alias("_size"))
        .join(F.broadcast(per_class), label)
        .withColumn("_cap", smallest * F.lit(ratio_cap))
        .withColumn("_take", F.when(F.col("n") <= F.col("_cap"), F.col("_size")).otherwise(
            F.greatest(F.lit(1), F.bround(F.col("_size") * (
                F.col("_cap").cast("double") / F.col("n")))).cast("long")))
        .select(label, "_m", "_p", "_before", "_take"))
    order = Window.partitionBy(label, "_m", "_p").orderBy("_h", id_col)
    # plan: at most classes x months x 4096 prefixes
    return (drawn.withColumn("_r", F.row_number().over(order))
            .join(F.broadcast(plan), [label, "_m", "_p"])
            .where(F.col("_before") + F.col("_r") <= F.col("_take"))
            .select(*df.columns))


def split(df: DataFrame, id_col: str = "detection_id", seed: int = 42,
          weights: tuple[float, float, float] = (0.70, 0.15, 0.15),
          label: str = "target_label") -> DataFrame:
    """Add ``split`` (train / validation / test) with the same shares in every label.

    Rows of a label are ranked by md5(id, seed); as in ``balance`` a rank is the rank inside a
    3-digit hash prefix plus the rows of smaller prefixes, so a large label is no bottleneck.
    """
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}:split")))
    drawn = df.withColumn("_h", digest).withColumn("_p", F.substring("_h", 1, 3))
    cells = drawn.groupBy(label, "_p").agg(F.count(F.lit(1)).alias("_c"))
    of_label = Window.partitionBy(label)
    plan = cells.select(
        F.col(label).alias("_l"), F.col("_p").alias("_q"),
        F.coalesce(F.sum("_c").over(of_label.orderBy("_p").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(of_label).alias("_size"))
    order = Window.partitionBy(label, "_p").orderBy("_h", id_col)
    rank = F.col("_before") + F.col("_r")
    first, second = (F.floor(F.col("_size") * w + 0.5) for w in (weights[0], weights[0] + weights[1]))
    # plan: at most labels x 4096 prefixes
    return (drawn.withColumn("_r", F.row_number().over(order))
            .join(F.broadcast(plan), F.col(label).eqNullSafe(F.col("_l")) & (F.col("_p") == F.col("_q")))
            .select(*df.columns, F.when(rank <= first, "train").when(rank <= second, "validation")
                    .otherwise("test").alias("split")))


def prior_factors(full: DataFrame, sampled: DataFrame, label: str = "target_label") -> DataFrame:
    """Per class: true share over sampled share."""
    def share(df, name):
        counts = class_counts(df, label)
        total = counts.agg(F.sum("n")).scalar()
        return counts.select(label, (F.col("n") / total).alias(name))

    return share(full, "true_share").join(share(sampled, "sampled_share"), label) \
        .withColumn("factor", F.col("true_share") / F.col("sampled_share"))


def apply_prior(probabilities: Column, factors: Column) -> Column:
    """Multiply an array of class probabilities by class factors and renormalise."""
    weighted = F.zip_with(probabilities, factors, lambda p, f: p * f)
    total = F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)
    return F.transform(weighted, lambda v: F.when(total > 0, v / total).otherwise(v))


def label_shares(df: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Label counts and shares, optionally inside a (west, south, east, north) box."""
    if box is not None:
        west, south, east, north = box
        df = df.where(F.col("longitude").between(west, east)
                      & F.col("latitude").between(south, north))
    outside = ~norm_bool(column_or(df, "inside_industrial"))
    counts = df.groupBy("target_label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("unmapped"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("target_label", "n", "unmapped", (F.col("n") / total).alias("share"))
