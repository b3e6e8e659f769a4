"""Exact percentiles (linear interpolation) that never gather a column in one task.

Values are counted, counted values are cut into slots, and only slot totals are ranked together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_percentiles(df: DataFrame, value: Column, probs: Sequence[float],
                      names: Sequence[str], group: Sequence[str] = (),
                      slot_width: float = 1.0) -> DataFrame:
    """One row per group: its count ``n`` and the named percentiles of the non-null values."""
    group = list(group)
    counted = (df.select(*group, value.cast("double").alias("_v")).where("_v IS NOT NULL")
               .groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
               .withColumn("_slot", F.floor(F.col("_v") / slot_width)))
    slots = counted.groupBy(*group, "_slot").agg(F.sum("_c").alias("_m"))
    by_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = slots.select(
        *group, "_slot",
        F.coalesce(F.sum("_m").over(by_group.orderBy("_slot").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_m").over(by_group).alias("_n"))
    inner = Window.partitionBy(*group, "_slot").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = (counted.withColumn("_in", F.coalesce(F.sum("_c").over(inner), F.lit(0)))
              .join(before, group + ["_slot"])
              .withColumn("_lo", F.col("_base") + F.col("_in"))
              .withColumn("_hi", F.col("_lo") + F.col("_c")))

    def holds(rank):
        return (F.col("_lo") <= rank) & (rank < F.col("_hi"))

    picks = []
    for p, name in zip(probs, names):
        place = (F.col("_n") - 1) * F.lit(float(p))
        low = F.floor(place)
        high = F.least(low + 1, F.col("_n") - 1)
        picks += [F.max(F.when(holds(low), F.col("_v"))).alias(f"{name}_a"),
                  F.max(F.when(holds(high), F.col("_v"))).alias(f"{name}_b")]
    found = ranked.groupBy(*group).agg(F.max("_n").alias("n"), *picks)
    outs = []
    for p, name in zip(probs, names):
        place = (F.col("n") - 1) * F.lit(float(p))
        part = place - F.floor(place)
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        outs.append((a + (b - a) * part).alias(name))
    return found.select(*group, F.coalesce("n", F.lit(0)).alias("n"), *outs)
