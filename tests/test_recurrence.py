"""Thirty-day history against a sequential fold, with ties, hot keys and input order."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.operators import recurrence as R
from emberline.operators import running

DAY = C.DAY_US
BASE = 1_704_067_200_000_000


def fold(rows):
    """The rules written as one pass in (time, id) order."""
    seen, first, persistent, areas, out = defaultdict(list), {}, {}, defaultdict(list), {}
    rows = sorted(rows, key=lambda r: (r["us"], r["detection_id"]))
    start = rows[0]["us"]
    for r in rows:
        key, us = r["recurrence_key"], r["us"]
        prior = [x for x in seen[key] if x[0] >= us - 30 * DAY]
        if len(prior) >= 8:
            persistent.setdefault(key, us)
        first.setdefault(key, us)
        near = {k for t, k in areas[r["area"]] if t >= us - 30 * DAY and k != key}
        values = [x[1] for x in prior]
        mu = sum(values) / len(values) if values else r["frp"]
        var = max(sum(v * v for v in values) / len(values) - mu * mu, 0) if len(values) > 1 else 1.0
        seen[key].append((us, r["frp"]))
        areas[r["area"]].append((us, key))
        n24 = sum(t >= us - DAY for t, _ in prior) + 1
        rate = (len(prior) + 1 - n24) / 29
        out[r["detection_id"]] = (
            len(prior), n24, len(near), (us - first[key]) / DAY,
            (persistent[key] - start) / DAY if key in persistent else -1.0,
            mu, var, n24 / rate if rate > 0 else 0.0)
    return out


def random_rows(n=900, seed=7):
    rng = random.Random(seed)
    return [dict(detection_id=i, us=BASE + rng.randrange(0, 180) * (DAY // 2),
                 frp=round(rng.uniform(0.1, 90), 2), recurrence_key=f"k{min(rng.randrange(12), 8)}",
                 area=rng.randrange(3), latitude=1.0, longitude=1.0, inside_industrial=i % 3 == 0)
            for i in range(n)]


SCHEMA = ("detection_id long, us long, frp double, recurrence_key string, area long, "
          "latitude double, longitude double, inside_industrial boolean")


def frame(spark, rows):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    return df.withColumn("timestamp_utc", F.timestamp_micros("us"))


@pytest.mark.parametrize("cfg", [R.RecurrenceConfig(),
                                 R.RecurrenceConfig(hot_min_rows=60, chunk_us=9 * DAY),
                                 R.RecurrenceConfig(hot_min_rows=60, chunk_us=9 * DAY, chunk_rows=7)])
def test_matches_sequential_fold(spark, cfg):
    rows = random_rows()
    want = fold(rows)
    df = frame(spark, rows)
    got = R.neighbourhood(R.source_history(df, cfg), cfg, df).collect()
    assert len(got) == len(rows)
    for g in got:
        have = (g.n_30d, g.n_24h, g.neighbourhood_active_keys, g.source_age_days,
                g.onset_lag_days, g.mu_raw, g.var_raw, g.burst_raw)
        assert have == pytest.approx(want[g.detection_id], abs=1e-6)


def test_burst_hour_of_a_hot_source_is_cut_by_rank(spark):
    rng = random.Random(11)
    second, hour = 1_000_000, 3600 * 1_000_000
    times = [rng.randrange(hour) for _ in range(3000)]                       # spread over the hour
    times += [1700 * second + rng.randrange(second) for _ in range(3000)]    # one crowded second of it
    times += [1700 * second + 5] * 90                                        # one instant
    times += [rng.randrange(30 * 24) * hour for _ in range(500)]
    rows = [dict(detection_id=i, us=BASE + us, frp=float(i % 50), recurrence_key="hot" if i % 9 else f"k{i % 7}", area=1,
                 latitude=1.0, longitude=1.0, inside_industrial=False) for i, us in enumerate(times)]
    df = frame(spark, rows)
    hot = spark.createDataFrame([("hot",)], "recurrence_key string")
    at = df.where("recurrence_key = 'hot'").select("recurrence_key", F.col("us").alias("t"))
    cuts = running.cut_points(at, ["recurrence_key"], "t", rows=100)
    sizes = running.chunked(at, ["recurrence_key"], "t", hot, cuts=cuts).groupBy("_chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).orderBy("_chunk").collect()
    assert max(r.n for r in sizes) <= 200 and len(sizes) > 50
    assert all(x.b < y.a for x, y in zip(sizes, sizes[1:])) and all(r["_chunk"] <= r.a for r in sizes)
    assert sum(r.n for r in sizes) == at.count()
    cut = R.RecurrenceConfig(hot_min_rows=1000, chunk_rows=100)
    a = R.evaluate(df, cut).collect()
    b = R.evaluate(df).collect()
    assert sorted(a, key=lambda r: r.detection_id) == sorted(b, key=lambda r: r.detection_id)


def test_even_hours_need_no_cuts(spark):
    rows = [("k", BASE + i * 3600 * 1_000_000) for i in range(50)]
    times = spark.createDataFrame(rows, "recurrence_key string, t long")
    assert running.cut_points(times, ["recurrence_key"], "t", rows=1) is None
    assert running.cut_points(times.limit(0), ["recurrence_key"], "t", rows=1) is None


def test_order_and_partitioning_do_not_matter(spark):
    rows = random_rows(400, 3)
    a = R.evaluate(frame(spark, rows).repartition(1))
    random.Random(1).shuffle(rows)
    b = R.evaluate(frame(spark, rows).repartition(64))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def points(spark, rows, columns="latitude double, longitude double, frp double, day double, "
           "inside_industrial boolean, osm_id string"):
    df = spark.createDataFrame(rows, columns).withColumn(
        "detection_id", F.monotonically_increasing_id())
    return df.withColumn("timestamp_utc", F.timestamp_micros(
        (F.lit(BASE) + F.col("day") * DAY).cast("long"))).drop("day")


def test_eight_prior_days_make_a_baseline(spark):
    rows = [(22.3, 69.8, 15.0, float(d), False, None) for d in range(8)]
    rows.append((22.3, 69.8, 15.2, 8.0, False, None))
    last = R.evaluate(points(spark, rows)).orderBy(F.desc("us")).first()
    assert (last.n_30d, last.state, last.suppressed) == (8, "PERSISTENT_BASELINE", True)


def test_site_identity_pools_scattered_points(spark):
    rows = [(22.33 + i * 0.004, 69.86, 15.0, float(i), True, "way/999") for i in range(9)]
    pooled = R.evaluate(points(spark, rows)).agg(F.max("n_30d")).first()[0]
    loose = [r[:5] + (None,) for r in rows]
    spread = R.evaluate(points(spark, loose)).agg(F.max("n_30d")).first()[0]
    assert pooled == 8 and spread < 8


@pytest.mark.parametrize("bad", [None, "", "   ", "nan", "None", "null"])
def test_unusable_ids_fall_back_to_the_cell(spark, bad):
    row = R.with_keys(points(spark, [(22.3, 69.8, 1.0, 0.0, True, bad)])).first()
    assert row.recurrence_key.startswith("hex:")


def test_rows_without_time_or_place_are_quarantined(spark):
    df = points(spark, [(22.3, 69.8, 1.0, 0.0, True, "a"), (None, 69.8, 1.0, 0.0, True, "a"),
                        (22.3, 69.8, 1.0, None, True, "a")])
    good, bad = R.quarantine(df)
    assert (good.count(), bad.count()) == (1, 2)
