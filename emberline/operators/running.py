"""Ordered running totals per key that stay parallel inside a hot key.

Cold keys are one window partition. A hot key is cut into time chunks, crowded ones by rank:
totals run inside each chunk, and a chunk-level prefix (a few thousand rows per key and year, and
one for every so many rows of crowded hours) supplies what came before. Sums and minima over an unbounded frame cost O(1) per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.operators import skew
from emberline.session import checkpoint_root

HOT_CHUNK_US = C.HOUR_US
#: A slot of a hot key with more rows is cut further, into chunks of at most twice so many.
CHUNK_ROWS = 50_000
#: Cut points that are sent to every task; more of them are joined by shuffle.
MOST_CUTS = 1_000_000
SECOND_US = 1_000_000


def cut_points(times: DataFrame, key: Sequence[str], time: str, width_us: int = HOT_CHUNK_US,
               rows: int = CHUNK_ROWS) -> DataFrame | None:
    """(key, _slot, _cuts): times at which crowded slots are cut, by rank; None if none is crowded.

    ``times`` has one row per event of a hot key. Events are counted by second, and by instant only
    in seconds that are crowded themselves, so every ordered pass is over a bounded number of counts:
    the seconds of a slot, the microseconds of a second. Events of one instant stay together.
    """
    key = list(key)
    t = F.col(time)
    placed = times.select(*key, t, F.floor(t / width_us).cast("long").alias("_slot"),
                          F.floor(t / SECOND_US).cast("long").alias("_second"))
    checkpoint_root(times.sparkSession)
    seconds = placed.groupBy(*key, "_slot", "_second").agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    crowded = (seconds.groupBy(*key, "_slot").agg(F.sum("_n").alias("_all"))
               .where(F.col("_all") > rows).select(*key, "_slot").checkpoint())
    if crowded.isEmpty():
        return None

    def before(group, order):
        earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(earlier), F.lit(0))

    slot, second = [*key, "_slot"], [*key, "_slot", "_second"]
    inside = seconds.join(crowded, slot, "left_semi").withColumn("_before", before(slot, "_second"))
    dense = inside.where(F.col("_n") > rows).select(*second, F.col("_before").alias("_base"))
    instants = (placed.join(dense.select(*second), second, "left_semi")
                .groupBy(*second, time).agg(F.count(F.lit(1)).alias("_n"))
                .withColumn("_inside", before(second, time)).join(dense, second)
                .select(*slot, t.alias("_start"), (F.col("_base") + F.col("_inside")).alias("_before")))
    start = F.greatest(F.col("_second") * SECOND_US, F.col("_slot") * width_us)
    pieces = inside.where(F.col("_n") <= rows).select(*slot, start.alias("_start"), "_before").unionByName(instants)
    return (pieces.groupBy(*slot, F.floor(F.col("_before") / rows).alias("_rank")).agg(F.min("_start").alias("_cut"))
            .groupBy(*slot).agg(F.collect_list("_cut").alias("_cuts")).checkpoint())


def chunked(df: DataFrame, key: Sequence[str], time: str, hot: DataFrame | None,
            width_us: int = HOT_CHUNK_US, cuts: DataFrame | None = None) -> DataFrame:
    """Add ``_hot`` and ``_chunk``: where the row's time slot or part of one starts for hot keys, else 0."""
    slot = F.floor(F.col(time) / width_us).cast("long")
    tagged = skew.tag_hot(df, hot, key)
    if cuts is None:
        return tagged.withColumn("_chunk", F.when(F.col("_hot"), slot * width_us).otherwise(F.lit(0).cast("long")))
    few = (cuts.agg(F.sum(F.size("_cuts"))).first()[0] or 0) <= MOST_CUTS
    found = skew.lookup_join(tagged.withColumn("_slot", F.when(F.col("_hot"), slot)), cuts, [*key, "_slot"], "left",
                             spread=F.col(time), max_rows=MOST_CUTS if few else 0)
    last = F.array_max(F.filter("_cuts", lambda c: c <= F.col(time)))
    return found.select(*tagged.columns, F.when(F.col("_hot"), F.coalesce(last, F.col("_slot") * width_us))
                        .otherwise(F.lit(0).cast("long")).alias("_chunk"))


def running(df: DataFrame, key: Sequence[str], order: Sequence[Column],
            totals: dict[str, tuple[str, Column]], hot: DataFrame | None,
            include_current: bool = False, contributors: DataFrame | None = None) -> DataFrame:
    """Add running values to a frame prepared by ``chunked``.

    ``totals`` maps an output column to ("sum" | "min", input expression). The frame is every
    earlier row of the key in ``order``, plus the current one when asked. ``contributors`` may
    give the same inputs from a narrower plan for the chunk-level prefix to read.
    """
    key = list(key)
    fold = {"sum": F.sum, "min": F.min}
    frame = Window.partitionBy(*key, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if include_current else -1)

    def settle(name, kind, value):
        value = F.col(value)
        return (F.coalesce(value, F.lit(0)) if kind == "sum" else value).alias(name)

    local = df.select("*", *[fold[kind](expr).over(frame).alias(f"_l_{name}")
                             for name, (kind, expr) in totals.items()])
    if hot is None:
        return local.select(*df.columns, *[settle(name, kind, f"_l_{name}")
                                           for name, (kind, _) in totals.items()])
    source = df if contributors is None else contributors
    chunk_totals = source.where(F.col("_hot")).groupBy(*key, "_chunk").agg(
        *[fold[kind](expr).alias(f"_t_{name}") for name, (kind, expr) in totals.items()])
    prefix = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    before = chunk_totals.select(
        *key, "_chunk", *[fold[kind](f"_t_{name}").over(prefix).alias(f"_b_{name}")
                          for name, (kind, _) in totals.items()])
    joined = local.join(before, key + ["_chunk"], "left")

    def combine(name, kind):
        inside, carried = F.col(f"_l_{name}"), F.col(f"_b_{name}")
        if kind == "min":
            return F.least(inside, carried).alias(name)
        return (F.coalesce(inside, F.lit(0)) + F.coalesce(carried, F.lit(0))).alias(name)

    return joined.select(*df.columns, *[combine(name, kind)
                                        for name, (kind, _) in totals.items()])
