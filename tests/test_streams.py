"""Keyed stream state and refreshed tables against the batch operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.operators import incidents, recurrence
from emberline.plans import tables
from emberline.streaming import keyed, refreshed

SF = "/root/testdata/sf0.001"
CFG = recurrence.RecurrenceConfig()


class State:
    """What a processor sees of its state."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def give(processor, state, rows):
    frame = pd.DataFrame(rows, columns=["detection_id", "us", "frp", "inside"])
    frame = frame.astype({"us": np.int64, "frp": float})
    return pd.concat(list(processor(("fac:1",), iter([frame]), state)), ignore_index=True)


def day(d, i, frp=5.0):
    return (i, int(d * C.DAY_US), frp, True)


def test_any_split_and_order_gives_the_batch_answer(spark):
    rng = np.random.default_rng(6)
    times = np.sort(rng.integers(0, 200 * 24, 300)) / 24
    rows = [day(t, i, float(rng.integers(1, 4000)) / 16) for i, t in enumerate(times)]
    delayed = sorted(rows, key=lambda r: (r[1] + int(rng.integers(0, 2 * C.DAY_US)), r[0]))
    processor, state, seen = keyed.SourceHistory(CFG, 3), State(), {}
    at = 0
    while at < len(delayed):
        n = int(rng.integers(1, 40))
        out = give(processor, state, delayed[at:at + n] + delayed[max(0, at - 3):at])     # some rows come again
        assert not out["late"].any()
        seen |= {r.detection_id: r for r in out.itertuples()}
        at += n
    df = spark.createDataFrame([(*r, "fac:1") for r in rows], "detection_id long, us long, frp double, inside boolean, recurrence_key string")
    want = recurrence.source_history(df.withColumn("timestamp_utc", F.timestamp_micros("us")), CFG).collect()
    for r in want:
        mine = seen[r.detection_id]
        assert (mine.n_30d, mine.mu_raw, mine.var_raw, mine.n_24h, mine.burst_raw) == (r.n_30d, r.mu_raw, r.var_raw, r.n_24h, r.burst_raw)
        assert (mine.us - mine.first_us) / C.DAY_US == r.source_age_days
        lag = -1.0 if pd.isna(mine.persistent_us) else max((mine.persistent_us - rows[0][1]) / C.DAY_US, 0.0)
        assert lag == r.onset_lag_days


def test_only_rows_behind_a_delayed_one_are_scored_again():
    processor, state = keyed.SourceHistory(CFG, 3), State()
    give(processor, state, [day(d, d) for d in range(20)])
    out = give(processor, state, [day(17.5, 100)])
    assert dict(zip(out["detection_id"], out["revised"], strict=True)) == {100: False, 18: True, 19: True}
    assert out.set_index("detection_id")["n_30d"].to_dict() == {100: 18, 18: 19, 19: 20}


def test_late_rows_come_out_unscored_and_change_nothing():
    processor, state = keyed.SourceHistory(CFG, 3), State()
    give(processor, state, [day(d, d) for d in range(20)])
    kept = state.value
    out = give(processor, state, [day(2.5, 100)])
    assert out["late"].tolist() == [True] and out["n_30d"].isna().all()
    assert state.value == kept


def test_state_holds_one_window_and_outlives_silence():
    processor, state = keyed.SourceHistory(CFG, 3, idle_ms=7), State()
    give(processor, state, [day(d / 4, d) for d in range(4 * 300)])
    readings = keyed.pickle.loads(state.value[3])
    assert len(readings["us"]) == 33 * 4 + 1 and state.timeout == 7
    state.hasTimedOut = True
    assert list(processor(("fac:1",), iter([]), state)) == []
    assert state.value[3] is None and state.value[1] == 0 and state.value[2] == 2 * C.DAY_US
    state.hasTimedOut = False
    out = give(processor, state, [day(400, 9999)])
    assert out["n_30d"].tolist() == [0] and out["first_us"].tolist() == [0] and out["persistent_us"].tolist() == [2 * C.DAY_US]


def test_a_batch_reads_no_history(spark, tmp_path):
    df = tables.keyed(spark, SF)
    cut = df.agg(F.expr("percentile_approx(us, 0.5)")).first()[0]
    found = []
    for k, part in enumerate((df.where(F.col("us") < cut), df.where(F.col("us") >= cut))):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        found.append(keyed.run_batch(keyed.history_stream(src), str(tmp_path / "out")))
        assert found[k]["rows_in"] == part.count()
    assert found[1]["state_rows"] >= df.select("recurrence_key").distinct().count() and found[1]["state_bytes"] > 0
    got = keyed.newest(spark, str(tmp_path / "out"))
    assert got.count() == df.count()


def test_keys_share_a_state_and_keep_their_own_answers():
    class Shared(State):
        now = 0

        def getCurrentProcessingTimeMs(self):
            return self.now

    rng = np.random.default_rng(8)
    rows = [(i, int((t - 9 * (i % 40 == 39)) * C.DAY_US), float(rng.integers(1, 4000)) / 16, True, [None, "a", "b", "c"][k])
            for i, (t, k) in enumerate(zip(np.sort(rng.random(400)) * 200 + rng.random(400) * 5, rng.integers(0, 4, 400), strict=True))]
    frame = pd.DataFrame(rows, columns=["detection_id", "us", "frp", "inside", "_key"])
    one, shared, alone, late = keyed.SourceHistory(CFG, 3, idle_ms=1000), Shared(), {}, 0
    both = keyed.Buckets(one)
    for at in range(0, 400, 37):
        part = frame[at:at + 37]
        got = pd.concat(list(both((1,), iter([part]), shared))).set_index("detection_id").sort_index()
        want = pd.concat([pd.concat(list(one((k,), iter([g]), alone.setdefault(k, State()))))
                          for k, g in part.groupby(part["_key"].fillna("none"))]).set_index("detection_id").sort_index()
        for c in ("n_30d", "mu_raw", "var_raw", "first_us", "persistent_us", "n_24h", "burst_raw", "late", "revised"):
            assert got[c].fillna(-1).tolist() == want[c].fillna(-1).tolist()
        assert got["recurrence_key"].fillna("none").tolist() == want["recurrence_key"].tolist()
        late += int(got["late"].sum())
    assert late > 0 and len(keyed.pickle.loads(shared.value[0])[0]) == 4
    shared.now = 2000                                        # silent for too long: readings go, instants stay
    out, = both((1,), iter([pd.DataFrame([(9999, 201 * C.DAY_US, 5.0, True, "a")], columns=frame.columns)]), shared)
    assert out["n_30d"].tolist() == [0] and out["first_us"].tolist() == [alone["a"].value[1]]
    names, _, sizes, kept = keyed.pickle.loads(shared.value[0])
    assert len(names) == 4 and sum(sizes) == len(kept["us"]) == 1


def test_many_keys_make_few_calls(spark, tmp_path):
    df = tables.keyed(spark, SF)
    df.write.parquet(str(tmp_path / "in"))
    for name, operator, whole, columns in (
            ("history", keyed.history_stream, recurrence.source_history(df), ("n_30d", "mu_raw", "var_raw")),
            ("activity", keyed.activity_stream, recurrence.neighbourhood(df), ("neighbourhood_active_keys",))):
        src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        assert keyed.run_batch(operator(src, buckets=3), str(tmp_path / name))["state_rows"] <= 3
        got, want = (sorted(tuple(r) for r in x.select("detection_id", *columns).collect()) for x in (keyed.newest(spark, str(tmp_path / name)), whole))
        assert got == want


def refreshed_rows(spark):
    df = tables.keyed(spark, SF).select("detection_id", "frp", "area", "timestamp_utc")
    return df, [df.where(F.pmod("detection_id", F.lit(3)) == b) for b in range(3)]


def same_tables(spark, sink, df):
    table = sink.incidents_table.read(spark)
    assert sorted(r.detection_id for r in table.collect()) == sorted(r.detection_id for r in df.collect())
    want = {r.area: r for r in incidents.cell_baseline(df, "area").collect()}
    got = {r.area: r for r in sink.baselines_table.read(spark).collect()}
    assert set(got) == set(want)
    for a, r in got.items():
        assert r.n == want[a].n and r.mean == pytest.approx(want[a].mean) and r.variance == pytest.approx(want[a].variance, abs=1e-6)


def test_refreshes_replays_and_restated_rows(spark, tmp_path):
    df, parts = refreshed_rows(spark)
    sink = refreshed.Refresh(str(tmp_path), buckets=4)
    sink(parts[0], 0)
    sink(parts[1].unionByName(parts[0].limit(50)), 1)
    sink(parts[0], 0)                                        # replayed, changes nothing
    sink(parts[1].unionByName(parts[0].limit(50)), 1)
    sink(parts[2].limit(0), 2)
    sink(parts[2], 3)
    same_tables(spark, sink, df)
    record = refreshed.refresh_record(spark, str(tmp_path)).first()
    assert (record.runs, record.failures, record.still_failing) == (4, 0, 0)


def test_a_refresh_that_broke_off_ends_the_same(spark, tmp_path, monkeypatch):
    df, parts = refreshed_rows(spark)
    sink = refreshed.Refresh(str(tmp_path), buckets=4)
    sink(parts[0].unionByName(parts[1]), 0)

    def fail(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as broken:
        broken.setattr(sink.baselines_table, "apply", fail)
        with pytest.raises(RuntimeError):
            sink(parts[2], 1)
    record = refreshed.refresh_record(spark, str(tmp_path)).first()
    assert (record.runs, record.failures, record.still_failing, record.rows) == (2, 1, 1, df.count() - parts[2].count())
    sink(parts[2], 1)
    same_tables(spark, sink, df)
    record = refreshed.refresh_record(spark, str(tmp_path)).first()
    assert (record.runs, record.failures, record.still_failing, record.rows) == (2, 1, 0, df.count())


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    table = refreshed.RefreshedTable(str(tmp_path), "k", refreshed.insert_new("k"), buckets=8)
    table.apply(spark.range(200).select(F.col("id").alias("k")), 0)
    before = {r.bucket: r.held for r in table.manifest(spark)}
    table.apply(spark.createDataFrame([(1000,)], "k long"), 1)
    after = {r.bucket: r.held for r in table.manifest(spark)}
    assert sum(before[b] != after[b] for b in before) == 1 and table.read(spark).count() == 201
