"""Corpus tables: ordered input choice, partitioned write, shrink guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import constants as C


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException:
        return False


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path of an ordered list that holds a table."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {list(paths)} exists")


def largest_corpus(spark: SparkSession, paths: Sequence[str], chosen: str | None = None) -> str:
    """An explicit choice wins, else the table with most rows (Parquet footers suffice)."""
    if chosen is not None:
        return chosen
    counts = {p: spark.read.parquet(p).count() for p in paths if exists(spark, p)}
    if not counts:
        raise FileNotFoundError("no corpus found")
    return max(sorted(counts), key=counts.get)


def shrink_reason(stored_rows: int, incoming_rows: int) -> str | None:
    """Why a replacement must be refused, or None."""
    if stored_rows > C.SHRINK_GUARD_ROWS \
            and incoming_rows * C.SHRINK_GUARD_FACTOR < stored_rows:
        return (f"refusing to replace {stored_rows} rows with {incoming_rows}: "
                f"more than {C.SHRINK_GUARD_FACTOR}x smaller")
    return None


def write_corpus(df: DataFrame, path: str) -> None:
    """Replace a corpus partitioned by month, unless that would shrink it drastically.

    Rows are clustered by month and a hash of the id, so a month is written by several tasks.
    """
    spark = df.sparkSession
    if exists(spark, path):
        reason = shrink_reason(spark.read.parquet(path).count(), df.count())
        if reason:
            raise ValueError(reason)
    month = F.date_format("timestamp_utc", "yyyy-MM")
    (df.withColumn("acq_month", F.coalesce(month, F.lit("unknown")))
     .repartition("acq_month", F.pmod(F.xxhash64("detection_id"), F.lit(8)))
     .write.mode("overwrite").partitionBy("acq_month").parquet(path))


def read_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def training_table(spark: SparkSession, path: str) -> DataFrame:
    """A training corpus; a missing or an empty one is refused rather than fitted on."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no training corpus at {path}")
    table = spark.read.parquet(path)
    if table.isEmpty():
        raise ValueError(f"the training corpus at {path} has no rows")
    return table
