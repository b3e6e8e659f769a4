"""Nearest neighbours by cosine: a vantage-point tree per shard, pruned by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import stored

#: Added to every pruning bound, so that rounding never cuts an exact search: dots are off by less than
#: TIE, chords near zero by less than the root of twice that.
ROUNDING, TIE = 2e-6, 1e-12
#: Points kept beyond k in a tree: the query itself and a few that tie; more are found by a second look.
SPARE = 9


class VpTree:
    """Unit vectors in an array, split at vantage points by the median chord to them."""

    def __init__(self, vectors: np.ndarray, leaf: int, seed: int = 7):
        self.vectors, self.leaf = vectors, leaf
        self.rows = np.arange(len(vectors))
        self.nodes: list[tuple] = []
        self.seed = np.random.default_rng(seed)
        self.root = self._build(0, len(vectors))

    def _build(self, start: int, end: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if end - start <= self.leaf:
            self.nodes[at] = (start, end, -1, 0.0, -1, -1)
            return at
        pick = start + int(self.seed.integers(end - start))
        self.rows[[start, pick]] = self.rows[[pick, start]]
        point = int(self.rows[start])
        rest = self.rows[start + 1:end]
        far = chord(self.vectors[rest] @ self.vectors[point])
        middle = len(rest) // 2
        order = np.argpartition(far, middle)
        self.rows[start + 1:end] = rest[order]
        cut = float(far[order[middle]])
        inner = self._build(start + 1, start + 1 + middle)
        outer = self._build(start + 1 + middle, end)
        self.nodes[at] = (start, end, point, cut, inner, outer)
        return at

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, dots), each k for a query, nearest first; row -1 where there are fewer.

        A branch is passed over when it lies beyond factor times the k-th best chord so far: one
        gives the exact answer, less gives up some of it for fewer comparisons.
        """
        best = np.full((len(queries), k), -np.inf)
        rows = np.full((len(queries), k), -1, np.int64)

        def offer(who: np.ndarray, dots: np.ndarray, which: np.ndarray) -> None:
            better = np.flatnonzero((dots > best[who, -1:]).any(1))
            if not len(better):
                return
            who, dots = who[better], dots[better]
            if dots.shape[1] > 2 * k:
                near = np.argpartition(-dots, k, 1)[:, :k]
                dots, which = np.take_along_axis(dots, near, 1), which[near]
            d = np.concatenate((best[who], dots), 1)
            r = np.concatenate((rows[who], np.broadcast_to(which, dots.shape)), 1)
            top = np.argsort(-d, 1, kind="stable")[:, :k]
            best[who], rows[who] = np.take_along_axis(d, top, 1), np.take_along_axis(r, top, 1)

        def visit(node: int, who: np.ndarray) -> None:
            start, end, point, cut, inner, outer = self.nodes[node]
            if not len(who) or start == end:
                return
            if point < 0:
                which = self.rows[start:end]
                offer(who, queries[who] @ self.vectors[which].T, which)
                return
            dots = queries[who] @ self.vectors[point]
            offer(who, dots[:, None], np.array([point]))
            far = chord(dots)
            inside = far < cut
            visit(inner, who[inside])
            visit(outer, who[~inside])
            reach = factor * chord(best[who, -1]) + ROUNDING
            other = np.abs(far - cut) <= reach
            visit(outer, who[inside & other])
            visit(inner, who[~inside & other])

        visit(self.root, np.arange(len(queries)))
        return rows, best


def chord(dots: np.ndarray) -> np.ndarray:
    """Distance of unit vectors from their dot product; infinite for none."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Each by its largest part: exact multiples become equal."""
    return v / np.abs(v).max(1, keepdims=True)


def _units(v: np.ndarray) -> np.ndarray:
    scaled = _scaled(v)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two arrays, in double precision; each is scaled by its largest part first."""
    a, b = a / np.abs(a).max(-1, keepdims=True), b / np.abs(b).max(-1, keepdims=True)
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def _cosine_of(q: np.ndarray, points: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine of q[i] and points[j], in slices of bounded memory."""
    out = np.empty(len(i))
    for at in range(0, len(i), 65_536):
        out[at:at + 65_536] = _cosine(q[i[at:at + 65_536]], points[j[at:at + 65_536]])
    return out


def _least(i: np.ndarray, j: np.ndarray, score: np.ndarray, held: np.ndarray, who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query i the k + 1 points j that come first by score, then by their least id other than its own."""
    first = np.where(held[j, 0] == who[i], held[j, 1], held[j, 0])
    by = np.lexsort((np.where(first < 0, np.iinfo(np.int64).max, first), -score, i))
    i, j = i[by], j[by]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth <= k], j[nth <= k]


def nearest(vectors: DataFrame, is_query: str, k: int = 5, factor: float = 1.0, id_col: str = "vec_id",
            vector_col: str = "embedding", shard_rows: int = 16_384, query_rows: int = 16_384,
            leaf: int = 512) -> DataFrame:
    """(query_id, rank, id_col, score): for each row that meets is_query its k nearest others by cosine.

    Rows are dealt to shards of about shard_rows by hash; a shard builds one tree, kept as a row of a
    table, and every block of about query_rows queries meets every tree. Vectors of a shard that are
    exact multiples of each other are one point of its tree with as many of its least ids as can be
    asked for, so a direction that fills a third of the rows costs no more than another. Where the
    points kept do not reach past what ties with the k-th, the query looks at all points of the shard.
    Per query and shard only k rows leave the task, and Spark keeps the best k before it shuffles again.

    Null, zero and non-finite vectors, empty ones and those with a null part take no part, nor do
    rows with a null id; vectors of different lengths do not meet. A query's own id is never its
    neighbour. Ties go to the smaller id; fewer candidates give fewer rows; of rows with one id and
    direction one is used. The score is computed on the vectors as given, in double precision.
    """
    parts = F.col(vector_col)
    fine = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(parts, lambda x: x != 0)
    clean = (vectors.where(F.col(id_col).isNotNull() & fine)
             .select(F.col(id_col).cast("long").alias("id"), parts.cast("array<double>").alias("v"),
                     F.size(parts).alias("dim"), F.coalesce(F.expr(is_query), F.lit(False)).alias("q")))
    sizes = clean.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("nq")).first()
    shards, groups = max(1, -(-sizes["n"] // shard_rows)), max(1, -(-sizes["nq"] // query_rows))

    def build(table: pa.Table) -> pa.Table:
        v, ids = _scaled(_matrix(table["v"].combine_chunks())), table["id"].to_numpy()
        order = np.lexsort((ids, *v.T[::-1]))
        v, ids = v[order], ids[order]
        head = np.ones(len(ids), bool)
        head[1:] = (v[1:] != v[:-1]).any(1)
        first = np.flatnonzero(head)
        held = np.full((len(first), k + 1), -1, np.int64)
        place = np.cumsum(head) - 1
        fresh = np.ones(len(ids), bool)
        fresh[1:] = head[1:] | (ids[1:] != ids[:-1])
        place, ids, first_at = place[fresh], ids[fresh], np.searchsorted(place[fresh], np.arange(len(first)))
        nth = np.arange(len(ids)) - first_at[place]
        held[place[nth <= k], nth[nth <= k]] = ids[nth <= k]
        return pa.table({"dim": table["dim"][:1], "shard": table["shard"][:1],
                         "points": pa.array([v[first].tobytes()], pa.binary()), "ids": pa.array([held.tobytes()], pa.binary())})

    def search(tree: pa.Table, asked: pa.Table) -> pa.Table:
        if not tree.num_rows or not asked.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64()))})
        held = np.frombuffer(tree["ids"][0].as_py(), np.int64).reshape(-1, k + 1)
        points = np.frombuffer(tree["points"][0].as_py(), np.float64).reshape(len(held), -1)
        found = VpTree(_units(points), leaf)
        out = []
        for at in range(0, asked.num_rows, 1024):
            part = asked.slice(at, 1024)
            q, who = _matrix(part["v"].combine_chunks()), part["id"].to_numpy()
            rows, dots = found.search(_units(q), k + SPARE, factor)
            last = dots[:, k] - TIE
            more = np.flatnonzero(dots[:, -1] >= last) if len(points) > k + SPARE else np.zeros(0, np.int64)
            few = np.ones(len(q), bool)
            few[more] = False
            i, j = np.nonzero((rows >= 0) & few[:, None])
            at_point = rows[i, j]
            for some in np.array_split(more, -(-len(more) // 64)) if len(more) else ():
                a, b = np.nonzero(_units(q[some]) @ found.vectors.T >= last[some, None])
                a = some[a]
                a, b = _least(a, b, _cosine_of(q, points, a, b), held, who, k)
                i, at_point = np.concatenate((i, a)), np.concatenate((at_point, b))
            score = _cosine_of(q, points, i, at_point)
            ids = held[at_point]
            query, ids, score = np.repeat(who[i], k + 1), ids.ravel(), np.repeat(score, k + 1)
            use = (ids >= 0) & (ids != query)
            query, ids, score = query[use], ids[use], score[use]
            by = np.lexsort((ids, -score, query))
            query, ids, score = query[by], ids[by], score[by]
            nth = np.arange(len(query)) - np.searchsorted(query, query)
            out.append(pa.table({"query_id": query[nth < k], "id": ids[nth < k], "score": score[nth < k]}))
        return pa.concat_tables(out)

    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    group = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int").alias("block")
    trees = stored(clean.select("id", "v", "dim", shard).groupBy("dim", "shard").applyInArrow(
        build, "dim int, shard int, points binary, ids binary"))
    asked = clean.where("q").select("id", "v", "dim", group).dropDuplicates(["id", "v"])
    every_block = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("block")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    keys = ("dim", "shard", "block")
    met = (trees.select("*", every_block).groupBy(*keys)
           .cogroup(asked.select("*", every_shard).groupBy(*keys))
           .applyInArrow(search, "query_id long, id long, score double"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (met.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
