"""Shallot search against plain rounds over every centroid."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from emberline.llm import shallot

SCHEMA = "vec_id long, embedding array<float>, ints string, cluster int"


def plain(rows, k, rounds, dims, scale=64.0):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [v for _, v in start[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        groups = {}
        for (_, v), (_, j) in zip(kept, nearest(), strict=True):
            groups.setdefault(j, []).append(v)
        at = [[sum(c) // len(c) for c in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(at)]
    last = nearest()
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), tuple(at[j])) for (i, _), (d, j) in zip(kept, last, strict=True)]


def check(spark, rows, k, rounds, dims):
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], SCHEMA).repartition(3)
    got = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid))
           for r in shallot.cluster(df, k=k, rounds=rounds, dims=dims).collect()]
    assert Counter(got) == Counter(plain(rows, k, rounds, dims))
    return got


def test_matches_plain_rounds(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5)) * 2
    rows = [(i, (centres[i % 6] + rng.normal(size=5) * 0.3).tolist()) for i in range(900)]
    check(spark, rows, 9, 3, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, -inf]), (6, [1.0, 2.0, 3.0]), (7, [0.0, -0.0]),
            (8, [0.5, -0.51]), (8, [0.5, -0.51]), (9, [-1e-9, 2.0]), (None, [4.0, 4.0]), (None, [4.0, 4.0]), (10, [100.25, -7.0])]
    got = check(spark, rows, 4, 3, 2)
    assert len(got) == 7
    check(spark, rows, 40, 2, 2)                # more centroids than vectors
    check(spark, rows, 1, 2, 2)


def test_ties_and_copies(spark):
    # equal centroids, vectors midway, and one vector that makes up a third of all rows
    grid = [(i, [float(i % 5), float(i // 5 % 5)]) for i in range(100)]
    check(spark, grid + [(1000 + i, [2.0, 2.0]) for i in range(50)], 12, 4, 2)


def test_no_vector(spark):
    df = spark.createDataFrame([(1, None, "", 0)], SCHEMA)
    out = shallot.cluster(df)
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_component_without_distance_is_told(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0], "", 0)], SCHEMA)
    with pytest.raises(Exception, match="no distance in 64 bits"):
        shallot.cluster(df, dims=2)


def test_bounds_save_distances():
    rng = np.random.default_rng(2)
    centres = rng.integers(-2000, 2000, (32, 16))
    x = (centres[rng.integers(0, 32, 5000)] + rng.integers(-60, 60, (5000, 16))).astype(np.int64)
    measured = []

    class Counted(shallot.Centroids):
        def squared(self, v, j):
            measured.append(len(v))
            return super().squared(v, j)

    at = x[:32].copy()
    state = np.zeros(5000, np.int64), np.ones(5000, np.int64), np.full(5000, np.inf), np.zeros(5000)
    state = shallot.assign(x, Counted(at), *state)
    for _ in range(4):
        before, at = at, np.array([x[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else at[j]
                                   for j in range(32)])
        measured.clear()
        state = shallot.assign(x, Counted(at, before), *state)
        every = np.square(x[:, None] - at[None]).sum(2)
        assert (state[0] == every.argmin(1)).all()
        assert (state[2] ** 2 >= every.min(1)).all()
    assert sum(measured) < 5000 * 32 / 8
