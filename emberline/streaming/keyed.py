"""Detections as a stream with keyed state: a batch touches the sources and areas it has rows of, no history is read."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberline import constants as C
from emberline.functions.text import norm_bool, number_or
from emberline.operators import recurrence
from emberline.operators.recurrence import _HI, _UNIT

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "keys binary"
#: Keys share so many states, which bounds the calls of a batch; fixed for the life of a checkpoint.
BUCKETS = 8192
HISTORY = ("n_30d int, mu_raw double, var_raw double, first_us long, persistent_us long, n_24h int, burst_raw double, "
           "late boolean, revised boolean")
ACTIVITY = "neighbourhood_active_keys int, late boolean, revised boolean"
NEVER = np.iinfo(np.int64).max

Columns = dict[str, np.ndarray]
State = tuple[int | None, int | None, int | None, Columns | None]


def use_state_store(spark: SparkSession) -> None:
    """Keyed state lives in the disk-backed store; its snapshots go to the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _take(rows: Columns, which: np.ndarray) -> Columns:
    return {c: v[which] for c, v in rows.items()}


def _columns(batches: Iterator[pd.DataFrame], names: tuple[str, ...]) -> Columns:
    parts = [{c: b[c].to_numpy() for c in names} for b in batches]
    return {c: np.concatenate([p[c] for p in parts]) for c in names}


class _Recent:
    """The recent readings of a key, kept as long as a row may still need or revise them.

    A reading is late if it is more than lateness_days older than the newest of its key in earlier
    batches; it comes out marked and unscored and changes nothing. Any other one is put in its place, and the rows after it
    are scored again, at most lateness and one window back: those are all that it can change. Readings
    before newest - lateness - window go when the key is touched, and all go when it was not touched
    for idle_ms; what must outlive them are two instants. A key's state is as large as its readings
    of one window and the lateness, whatever its history.
    """

    columns: tuple[str, ...] = ()

    def __init__(self, cfg: recurrence.RecurrenceConfig, lateness_days: int, idle_ms: int | None = None):
        self.cfg = cfg
        self.window, self.lateness = cfg.window_days * C.DAY_US, lateness_days * C.DAY_US
        self.idle_ms = idle_ms or (cfg.window_days + lateness_days) * 86_400_000

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, first, persistent, packed = state.get if state.exists else (None, None, None, None)
        if state.hasTimedOut:
            state.update((newest, first, persistent, None))
            return
        new = _columns(batches, ("detection_id", *self.columns))
        out, (*instants, kept) = self.advance(new, (newest, first, persistent, packed and pickle.loads(packed)))
        for rows, late, revised in out:
            yield self.told(key, rows, late, revised)
        state.update((*instants, pickle.dumps(kept, 5)))
        state.setTimeoutDuration(self.idle_ms)

    def advance(self, new: Columns, was: State) -> tuple[list[tuple[Columns, bool, np.ndarray]], State]:
        """What a key's new readings make known, as (rows, late, revised), and its state after them."""
        newest, first, persistent, kept = was
        out = []
        late = new["us"] < (-NEVER if newest is None else newest - self.lateness)
        newest = int(max(new["us"].max(), -NEVER if newest is None else newest))
        if late.any():
            out.append((_take(new, late), True, np.zeros(int(late.sum()), bool)))
        new = _take(new, ~late)
        kept = kept if kept is not None else _take(new, np.zeros(len(new["us"]), bool))
        # a row that a batch restates is there once
        _, once = np.unique(new["detection_id"], return_index=True)
        once = once[~np.isin(new["detection_id"][once], kept["detection_id"])]
        new = _take(new, once)
        if len(once):
            low = int(new["us"].min())
            every = {c: np.concatenate([kept[c], new[c]]) for c in new}
            revised = np.arange(len(every["us"])) < len(kept["us"])
            by = np.lexsort((every["detection_id"], every["us"]))
            every, revised = _take(every, by), revised[by]
            first = low if first is None else min(low, first)
            found, persistent = self.score(every, low, first, persistent)
            again = every["us"] >= low
            out.append((_take(every | found, again), False, revised[again]))
            kept = every
        return out, (newest, first, persistent, _take(kept, kept["us"] >= newest - self.lateness - self.window))

    def told(self, key: tuple, rows: Columns, late: bool, revised: np.ndarray) -> pd.DataFrame:
        raise NotImplementedError

    def score(self, every: Columns, low: int, first: int, persistent: int | None) -> tuple[Columns, int | None]:
        raise NotImplementedError


class SourceHistory(_Recent):
    """Thirty-day count, sums, burst, first sight and persistence of a source, as source_history has them."""

    columns = ("us", "frp", "inside")

    def score(self, every: Columns, low: int, first: int, persistent: int | None) -> tuple[Columns, int | None]:
        us, frp = every["us"], every["frp"]
        q = np.floor(frp * _UNIT + 0.5).astype(np.int64)
        square = q * q
        at = np.arange(len(us))
        start = np.searchsorted(us, us - self.window, "left")

        def before(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[at] - total[start]

        n, s1 = at - start, before(q)
        high, rest = before(np.floor(square / _HI).astype(np.int64)), before(square % _HI)
        n24 = at - np.searchsorted(us, us - self.cfg.burst_hours * C.HOUR_US, "left") + 1
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = s1 / n / _UNIT
            mean_sq = (high * float(_HI) + rest) / n / float(_UNIT * _UNIT)
            rate = (n + 1 - n24) / float(max(self.cfg.window_days - self.cfg.burst_hours / 24, 1))
            burst = np.where(rate > 0, n24 / (self.cfg.burst_hours / 24.0) / rate, 0.0)
        reached = np.where((n >= self.cfg.persistence_min) & (us >= low), us, NEVER)
        if persistent is not None and persistent < low:
            reached = np.minimum(reached, persistent)
        lasting = np.minimum.accumulate(reached)
        found = {"n_30d": n, "mu_raw": np.where(n > 0, mean, frp), "n_24h": n24, "burst_raw": burst,
                 "var_raw": np.where(n > 1, np.maximum(mean_sq - mean * mean, 0.0), 1.0),
                 "first_us": np.full(len(us), first), "persistent_us": lasting}
        last = int(lasting[-1])
        return found, persistent if last == NEVER else last if persistent is None else min(last, persistent)

    def told(self, key: tuple, rows: Columns, late: bool, revised: np.ndarray) -> pd.DataFrame:
        lasting = rows.get("persistent_us", np.full(len(revised), NEVER))
        return pd.DataFrame({
            "detection_id": rows["detection_id"], "recurrence_key": key[0], "us": rows["us"], "frp": rows["frp"],
            "inside_industrial": rows["inside"].astype(bool), **{c: rows.get(c) for c in ("n_30d", "mu_raw", "var_raw", "first_us")},
            "persistent_us": pd.arrays.IntegerArray(lasting, lasting == NEVER), "n_24h": rows.get("n_24h"),
            "burst_raw": rows.get("burst_raw"), "late": late, "revised": revised})


class AreaActivity(_Recent):
    """Other sources active in an area just before each detection, as neighbourhood has them."""

    columns = ("us", "recurrence_key")

    def score(self, every: Columns, low: int, first: int, persistent: int | None) -> tuple[Columns, int | None]:
        us = every["us"]
        source = pd.factorize(every["recurrence_key"])[0]
        by = np.argsort(source, kind="stable")
        opens = np.ones(len(by), bool)
        opens[1:] = (source[by][1:] != source[by][:-1]) | (np.diff(us[by]) > self.window)
        closes = np.append(opens[1:], True)
        started = np.zeros(len(us), np.int64)
        started[by[opens]] = 1
        ended = np.sort(us[by[closes]] + self.window + 1)
        active = np.cumsum(started) - np.searchsorted(ended, us, "right")
        return {"neighbourhood_active_keys": active - 1}, persistent

    def told(self, key: tuple, rows: Columns, late: bool, revised: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"detection_id": rows["detection_id"], "area": key[0], "us": rows["us"],
                             "neighbourhood_active_keys": rows.get("neighbourhood_active_keys"), "late": late, "revised": revised})


class Buckets:
    """The keys of a bucket, each with a state of its own (see _Recent), in one call and one stored value.

    A call costs far more than a key's arithmetic. The value lists the keys, four instants of each (newest,
    first, persistent, time of the last touch) and the readings of all, key by key; only the keys that a
    batch touches are scored. Readings of a key that was not touched for idle_ms go with the next touch of its bucket.
    """

    def __init__(self, one: _Recent):
        self.one = one

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, instants, sizes, rows = pickle.loads(state.get[0]) if state.exists else ([], np.zeros((0, 4), np.int64), [], {})
        if state.hasTimedOut:
            state.update((pickle.dumps((names, instants, [0] * len(names), {c: v[:0] for c, v in rows.items()}), 5),))
            return
        new = _columns(batches, ("detection_id", *self.one.columns, "_key"))
        now = state.getCurrentProcessingTimeMs()
        ends = np.cumsum([0, *sizes])
        known = {}
        for i, name in enumerate(names):
            newest, first, persistent, touched = instants[i].tolist()
            kept = {c: v[ends[i]:ends[i + 1]] for c, v in rows.items()} if now - touched < self.one.idle_ms else {c: v[:0] for c, v in rows.items()}
            known[name] = (newest, first, None if persistent == NEVER else persistent, kept), touched
        told = []
        code, found = pd.factorize(new.pop("_key"), use_na_sentinel=False)
        by = np.argsort(code, kind="stable")
        new, cuts = _take(new, by), np.cumsum([0, *np.bincount(code)])
        for i, name in enumerate(found.tolist()):
            name = None if pd.isna(name) else name
            was = known[name][0] if name in known else (None, None, None, None)
            out, after = self.one.advance({c: v[cuts[i]:cuts[i + 1]] for c, v in new.items()}, was)
            told += [(name, *o) for o in out]
            known[name] = after, now
        for late in (True, False):
            group = [(name, r, revised) for name, r, is_late, revised in told if is_late == late]
            if group:
                labels = np.repeat(np.array([name for name, _, _ in group], object), [len(revised) for _, _, revised in group])
                every = {c: np.concatenate([r[c] for _, r, _ in group]) for c in group[0][1]}
                yield self.one.told((labels,), every, late, np.concatenate([revised for _, _, revised in group]))
        kept = [s[3] for s, _ in known.values()]
        instants = np.array([(s[0], s[1], NEVER if s[2] is None else s[2], touched) for s, touched in known.values()], np.int64)
        state.update((pickle.dumps((list(known), instants, [len(k["us"]) for k in kept],
                                    {c: np.concatenate([k[c] for k in kept]) for c in new}), 5),))
        state.setTimeoutDuration(self.one.idle_ms)


def _by_bucket(rows: DataFrame, key: str, one: _Recent, schema: str, buckets: int) -> DataFrame:
    spread = rows.withColumns({"_key": F.col(key).cast("string"), "_bucket": F.pmod(F.xxhash64(key), F.lit(buckets))})
    return spread.groupBy("_bucket").applyInPandasWithState(
        Buckets(one), schema, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def readings(df: DataFrame) -> DataFrame:
    """What the state keeps of keyed detections (see recurrence.with_keys)."""
    inside = norm_bool(F.col("inside_industrial")) if "inside_industrial" in df.columns else F.lit(False)
    return df.select("detection_id", "us", number_or("frp", 0.0).alias("frp"),
                     F.coalesce(inside, F.lit(False)).alias("inside"), "recurrence_key", "area")


def history_stream(stream: DataFrame, cfg: recurrence.RecurrenceConfig = recurrence.RecurrenceConfig(),
                   lateness_days: int = 3, idle_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A row for each new or revised detection of a keyed stream, with the history of its source."""
    rows = readings(stream)
    kind = rows.schema["detection_id"].dataType.simpleString()
    return _by_bucket(
        rows, "recurrence_key", SourceHistory(cfg, lateness_days, idle_ms),
        f"detection_id {kind}, recurrence_key string, us long, frp double, inside_industrial boolean, {HISTORY}", buckets)


def activity_stream(stream: DataFrame, cfg: recurrence.RecurrenceConfig = recurrence.RecurrenceConfig(),
                    lateness_days: int = 3, idle_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A row for each new or revised detection of a keyed stream, with the activity of its area."""
    rows = readings(stream)
    kind = rows.schema["detection_id"].dataType.simpleString()
    out = _by_bucket(rows, "area", AreaActivity(cfg, lateness_days, idle_ms),
                     f"detection_id {kind}, area string, us long, {ACTIVITY}", buckets)
    return out.withColumn("area", F.col("area").cast("long"))


def run_batch(out: DataFrame, root: str) -> dict:
    """Everything that has arrived, as one batch under root; what the state did for it.

    Each batch is a table of its own, written over when it is replayed. (A trigger that ends when all is
    read would go on for ever, as clocks that may run out keep asking for one more batch.)
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch_id={batch_id}")

    use_state_store(out.sparkSession)
    query = out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(once=True).start()
    query.awaitTermination()
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    return {"batches": len(query.recentProgress), "rows_in": sum(p["numInputRows"] for p in query.recentProgress),
            "state_rows": states[-1]["numRowsTotal"] if states else 0,
            "state_bytes": states[-1]["memoryUsedBytes"] if states else 0}


def newest(spark: SparkSession, root: str) -> DataFrame:
    """The last word on every detection that was in time."""
    rows = spark.read.parquet(f"{root}/rows").where("not late")
    names = [c for c in rows.columns if c not in ("batch_id", "late", "revised")]
    return rows.groupBy("detection_id").agg(F.max_by(F.struct(*names), "batch_id").alias("r")).select("r.*")


def alert_rows(history: DataFrame, start_us: int | None = None) -> DataFrame:
    """Alert state of the rows of newest(); with the corpus' first instant also the onset lag."""
    age = F.greatest((F.col("us") - F.col("first_us")) / float(C.DAY_US), F.lit(0.0))
    out = history.withColumn("source_age_days", age)
    if start_us is not None:
        out = out.withColumn("onset_lag_days", F.when(F.col("persistent_us").isNotNull(), F.greatest(
            (F.col("persistent_us") - start_us) / float(C.DAY_US), F.lit(0.0))).otherwise(F.lit(-1.0)))
    return recurrence.with_alert_state(out.drop("first_us", "persistent_us"))
