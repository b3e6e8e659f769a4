"""Clusters of whole-number vectors around centroids: shallot search keeps exact answers with few distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import let_go, stored

#: Share by which bounds are widened, so that rounding never makes one wrong; the largest component.
SLACK, LARGEST = 1e-9, 1 << 24
STATE = "was int, cluster int, second int, distance long, upper double, lower double"


class Centroids:
    """Centroids, their distances, each one's neighbours in order, and how far each moved last."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        k = len(at)
        self.gap = np.sqrt(np.stack([np.square(at - c).sum(1) for c in at]).astype(np.float64))
        apart = self.gap + np.diag(np.full(k, -1.0))
        self.order = np.argsort(apart, 1, kind="stable")
        self.half = np.sort(apart, 1)[:, 1] / 2 if k > 1 else np.full(k, np.inf)
        moved = np.sqrt(np.square(at - before).sum(1).astype(np.float64)) if before is not None else np.zeros(k)
        self.moved = moved
        # the farthest move of any centroid but the vector's own
        self.others = np.array([max(np.delete(moved, j), default=0.0) for j in range(k)])

    def squared(self, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.square(x - self.at[j]).sum(1)


def assign(x: np.ndarray, c: Centroids, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray,
           lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, second, upper, lower) of vectors after the centroids moved; ties go to the smaller number.

    upper bounds the distance to the own centroid, lower that to any other; a vector whose upper
    bound stays below its lower bound, or below half the way to the own centroid's neighbour, keeps
    its cluster. The rest start from the closer one of the own and the second centroid and walk
    through that one's neighbours, nearest first, as long as they may lie in the ball that holds the
    two nearest: its radius is the distance to the start and to the second nearest so far, so it
    shrinks as nearer ones are met. Distances that decide are whole numbers.
    """
    k = len(c.at)
    upper = (upper + c.moved[cluster]) * (1 + SLACK)
    lower = (lower - c.others[cluster]) * (1 - SLACK)
    bound = np.maximum(lower, c.half[cluster] * (1 - SLACK))
    todo = np.flatnonzero(upper >= bound)
    own = c.squared(x[todo], cluster[todo])
    upper[todo] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    open_ = upper[todo] >= bound[todo]
    todo, own = todo[open_], own[open_]
    if k == 1 or not len(todo):
        return cluster, second, upper, lower
    v, first, other = x[todo], cluster[todo], second[todo]
    near = c.squared(v, other)
    swap = (near < own) | ((near == own) & (other < first))
    d1, d2 = np.where(swap, near, own), np.where(swap, own, near)
    first, other = np.where(swap, other, first), np.where(swap, first, other)
    start, away = first.copy(), np.sqrt(d1.astype(np.float64))
    live = np.arange(len(todo))
    for rank in range(1, k):
        j = c.order[start[live], rank]
        inside = c.gap[start[live], j] <= (away[live] + np.sqrt(d2[live].astype(np.float64))) * (1 + SLACK)
        live, j = live[inside], j[inside]
        if not len(live):
            break
        new = (j != first[live]) & (j != other[live])
        at, j = live[new], j[new]
        d = c.squared(v[at], j)
        best = (d < d1[at]) | ((d == d1[at]) & (j < first[at]))
        next_ = ~best & ((d < d2[at]) | ((d == d2[at]) & (j < other[at])))
        a = at[best]
        d2[a], other[a] = d1[a], first[a]
        d1[a], first[a] = d[best], j[best]
        a = at[next_]
        d2[a], other[a] = d[next_], j[next_]
    cluster, second = cluster.copy(), second.copy()
    cluster[todo], second[todo] = first, other
    upper[todo] = np.sqrt(d1.astype(np.float64)) * (1 + SLACK)
    lower[todo] = np.sqrt(d2.astype(np.float64)) * (1 - SLACK)
    return cluster, second, upper, lower


def vectors(table: DataFrame, dims: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(id_col, ints): vectors of dims finite components, each turned into floor(scale * component)."""
    v = F.col(f"`{vector_col}`")
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fit = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    small = F.forall(v, lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < LARGEST)
    beyond = F.raise_error(F.lit(f"a component beyond {LARGEST} in size has no distance in 64 bits"))
    return (table.where(F.coalesce(fit, F.lit(False)))
            .select(F.col(f"`{id_col}`"), F.when(small, whole.cast("array<int>")).otherwise(beyond.cast("array<int>")).alias("ints")))


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(1).flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def _sums(chosen: DataFrame, dims: int, k: int, start: list[list[int]]) -> list[list[int]]:
    """start ([count, *sums] by centroid) and the vectors that moved in, less those that moved out."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in let_go(batches):
            x = np.concatenate([np.ones((batch.num_rows, 1), np.int64), _rows(batch, dims)], 1)
            np.add.at(total, batch.column(3).to_numpy(), x)
            was = batch.column(2).to_numpy()
            np.subtract.at(total, was[was >= 0], x[was >= 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))],
                                         names=["cluster", "sums"])

    parts = (chosen.where("cluster != was").select(chosen.columns[0], "ints", "was", "cluster").mapInArrow(add, "cluster int, sums array<long>")
             .select("cluster", F.posexplode("sums").alias("place", "part"))
             .groupBy("cluster", "place").agg(F.sum("part").alias("part")))
    out = [list(row) for row in start]
    for r in parts.collect():                    # k * (dims + 1) numbers
        out[r.cluster][r.place] += r.part
    return out


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid) for each vector that takes part.

    Vectors are whole numbers (see vectors): those that are null, of other length, or hold a null or
    a component that is not finite take no part, and a component beyond LARGEST stops the job, since
    its distance has no 64-bit value. The k vectors of least sha256 of `seed:id` are the first
    centroids (of equal ids, the lesser vector first; null ids last); fewer vectors make fewer
    centroids. Each round assigns every vector and moves each centroid to the floor of its vectors'
    mean; one that has none stays. distance is squared. Equal rows are vectors of their own; no
    vector gives an empty table. Other columns are not read.

    A round is one pass over a written table that holds the vectors, packed, with their bounds; only
    vectors that changed cluster are read again to move the sums. The driver holds k centroids.
    """
    spark = table.sparkSession
    kept = stored(vectors(table, dims, scale, id_col, vector_col))
    name = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(f"`{id_col}`").cast("string")), 256)
    first = (kept.select(F.when(F.col(f"`{id_col}`").isNotNull(), name).alias("name"), "ints")
             .orderBy(F.col("name").asc_nulls_last(), "ints").limit(k).collect())
    id_type = table.schema[id_col].dataType
    if not first:
        return _result(kept.select(F.col(f"`{id_col}`"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")),
                       spark, np.zeros((0, dims), np.int64), id_col)
    at = np.array([r.ints for r in first], np.int64)
    k, before = len(at), None
    sums = [[0] * (dims + 1) for _ in range(k)]
    state = kept.select(F.col(f"`{id_col}`"), "ints", F.lit(-1).alias("cluster"), F.lit(0).alias("second"),
                        F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    for turn in range(rounds + 1):
        state = stored(_assigned(state, Centroids(at, before), id_col, id_type, dims))
        if turn < rounds:
            sums = _sums(state, dims, k, sums)
            before = at
            at = np.array([[s // row[0] for s in row[1:]] if row[0] else old for row, old in zip(sums, at.tolist(), strict=True)], np.int64)
        state = state.select(F.col(f"`{id_col}`"), "ints", "cluster", "second", "upper", "lower", "distance")
    return _result(state.select(F.col(f"`{id_col}`"), "cluster", "distance"), spark, at, id_col)


def _assigned(state: DataFrame, c: Centroids, id_col: str, id_type: T.DataType, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _rows(part, dims)
                was, second, upper, lower = (part.column(i).to_numpy() for i in range(2, 6))
                if (was < 0).any():
                    # nothing is known yet: start at the first centroid, with bounds that decide nothing
                    own, second = np.zeros(len(x), np.int32), np.full(len(x), min(1, len(c.at) - 1), np.int32)
                    upper, lower = np.full(len(x), np.inf), np.zeros(len(x))
                else:
                    own = was
                now, second, upper, lower = assign(x, c, own, second, upper, lower)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(was, pa.int32()), pa.array(now, pa.int32()), pa.array(second, pa.int32()),
                     pa.array(c.squared(x, now)), pa.array(upper), pa.array(lower)],
                    names=[id_col, "ints", "was", "cluster", "second", "distance", "upper", "lower"])

    return state.select(F.col(f"`{id_col}`"), "ints", "cluster", "second", "upper", "lower").mapInArrow(
        run, f"`{id_col}` {id_type.simpleString()}, ints array<int>, {STATE}")


def _result(chosen: DataFrame, spark: SparkSession, at: np.ndarray, id_col: str) -> DataFrame:
    """Adds the sums of distances and the centroids, from a table with a row for each centroid."""
    sums = {r.cluster: r.total for r in chosen.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    facts = spark.createDataFrame([(i, sums.get(i), sum(sums.values()), c) for i, c in enumerate(at.tolist())],
                                  "_c int, cluster_inertia long, inertia long, centroid array<long>")
    return (chosen.join(F.broadcast(facts), F.col("cluster") == F.col("_c"))
            .select(F.col(f"`{id_col}`"), "cluster", "distance", "cluster_inertia", "inertia", "centroid"))
