"""Shared guards against hot keys and unbounded broadcasts.

A key may hold a third of all rows. The helpers below keep every such group spread over
many tasks: hot keys are found by a map-side combined count, kept as a table that is joined, and
then split by time or by hash. What counts as hot is a number of rows, the same at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import checkpoint_root

HOT_MIN_ROWS = 200_000
BROADCAST_MAX_ROWS = 200_000


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_MIN_ROWS) -> DataFrame | None:
    """Keys with more than min_rows rows as a checkpointed table; None when there are none."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if (counts.agg(F.max("_n")).first()[0] or 0) <= min_rows:
        return None
    checkpoint_root(df.sparkSession)
    return counts.where(F.col("_n") > min_rows).select(*keys).checkpoint()


def tag_hot(df: DataFrame, hot: DataFrame | None, keys: Sequence[str],
            flag: str = "_hot") -> DataFrame:
    """Add a boolean column; Spark broadcasts ``hot`` if it is small and else splits the hot keys."""
    if hot is None:
        return df.withColumn(flag, F.lit(False))
    marked = hot.select(*keys, F.lit(True).alias(flag))
    return df.join(marked, list(keys), "left") \
        .withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def ensure_parallel(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan that yields fewer splits than the session has slots; otherwise unchanged.

    A table of one small file is one task however many cores there are. On a large table the
    scan already has more splits than slots and nothing is shuffled.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots, key)


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                spread: Column | None = None, salts: int = 32,
                max_rows: int = BROADCAST_MAX_ROWS, min_hot: int = HOT_MIN_ROWS) -> DataFrame:
    """Join a large frame to a lookup side.

    A proven-small lookup is broadcast. Otherwise both sides shuffle on the keys, and keys hot
    on the left are salted: left rows take a hash salt, matching lookup rows are repeated once
    per salt.
    """
    keys = list(keys)
    if is_small(right, max_rows):
        return left.join(F.broadcast(right), keys, how)
    hot = hot_keys(left, keys, min_hot)
    if hot is None:
        return left.join(right, keys, how)
    seed = spread if spread is not None else F.struct(*[F.col(c) for c in left.columns])
    salted_left = tag_hot(left, hot, keys).withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(seed), F.lit(salts)).cast("int"))
        .otherwise(0)).drop("_hot")
    salted_right = tag_hot(right, hot, keys).withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                           .otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted_left.join(salted_right, keys + ["_salt"], how).drop("_salt")


def match_join(left: DataFrame, right: DataFrame, keys: Sequence[str], right_keys: Sequence[str],
               salts: int = 32, min_hot: int = HOT_MIN_ROWS, null_safe: bool = False) -> DataFrame:
    """Left join to a side with at most one row per key. Hot keys are salted; rows without a key are spread.

    null_safe: a missing part of a key is a value like any other, and meets its like.
    """
    keys, back = list(keys), dict(zip(right_keys, keys, strict=True))
    hot = hot_keys(left, keys, min_hot)
    keyless = F.lit(False)
    for c in () if null_safe else keys:
        keyless = keyless | F.col(c).isNull()
    seed = [f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    salted = tag_hot(left, hot, keys).withColumn("_salt", F.when(
        F.col("_hot") | keyless, F.pmod(F.xxhash64(*[F.col(c) for c in seed]), F.lit(salts))).otherwise(0).cast("int")).drop("_hot")
    spread = tag_hot(right.withColumnsRenamed(back), hot, keys).withColumnsRenamed({k: r for r, k in back.items()}).withColumn(
        "_rsalt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    same = [F.col(k).eqNullSafe(F.col(r)) if null_safe else F.col(k) == F.col(r) for r, k in back.items()]
    return salted.join(spread, [F.col("_salt") == F.col("_rsalt"), *same], "left").drop("_salt", "_rsalt", *right_keys)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
          spread: Column, rank: str = "rank", salts: int = 64) -> DataFrame:
    """First k rows per group; a salted first pass bounds what a hot group sends on."""
    group = list(group)
    first = Window.partitionBy(*group, "_s").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn("_s", F.pmod(F.xxhash64(spread), F.lit(salts)))
            .withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
            .drop("_s", "_r")
            .withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the least by ``order``; combines map-side, so a hot key is cheap."""
    keys = list(keys)
    names = df.columns
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in names]), F.struct(*order)).alias("_row"))
    return picked.select("_row.*")
