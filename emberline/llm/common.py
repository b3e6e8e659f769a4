"""Helpers the operators share: word sets, shared storage, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a private one only in local mode without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


#: What an operator keeps in a Python worker from task to task.
_KEPT: dict = {}


def kept(name, make):
    """The object of that name in this worker, made once; those of other operators are let go."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def let_go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task whose operator keeps nothing; what others kept here is freed."""
    _KEPT.clear()
    yield from batches


#: Lets Spark delete the shuffle files of an execution when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: lineage ends here, lost executors cost nothing.

    The shuffle files of the write go as soon as the table is there.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def octets(column: str) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that near values get far hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def slices(batch: pa.RecordBatch, column: int, bytes_at_most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of bounded bytes (a single longer row is a run of its own)."""
    sizes = np.array([0 if v is None else len(v) for v in _lengths(batch.column(column))], np.int64) \
        if not pa.types.is_binary(batch.column(column).type) else _binary_sizes(batch.column(column))
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > bytes_at_most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def _lengths(array: pa.Array) -> list:
    return array.to_pylist()


def _binary_sizes(array: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
