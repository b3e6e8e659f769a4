"""Periodic runs of words: minimizers of several scales seed them, lag scans find the short periods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import let_go, mix, octets, slices

#: Log2 of the least period that minimizers seed; shorter ones are found by scans at their lag.
FIRST_SCALE = 3
ODD = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start: long, length: long, period: long>>"


def number_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, first, order): all texts as numbers in one array, longest text first.

    Equal words have equal numbers; a number that comes nowhere else ends each text. order are the
    texts as they follow in x, first their first places.
    """
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-counts, kind="stable")
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for i in order.tolist() for w in texts[i]), np.int64, int(counts.sum()))
    ends = np.cumsum(counts[order])
    stops = ends + np.arange(len(texts))
    x = np.empty(len(flat) + len(texts), np.int64)
    inner = np.ones(len(x), bool)
    inner[stops] = False
    x[inner] = flat
    x[stops] = len(ids) + np.arange(len(texts))
    return x, stops - counts[order], order


def lag_runs(x: np.ndarray, period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest stretches of least or more numbers that equal those a period before."""
    same = np.flatnonzero(x[period:] == x[:-period])
    if not len(same):
        return same, same
    cut = np.flatnonzero(np.diff(same) != 1)
    start = same[np.concatenate(([0], cut + 1))]
    end = same[np.concatenate((cut, [len(same) - 1]))] + 1 + period
    long_ = end - start >= least
    return start[long_], end[long_]


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash, the leftmost of equals, of every window of that many hashes."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64)
    bits = np.uint64((1 << n.bit_length()) - 1)
    padded = np.full(-(-n // window) * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = (h & ~bits) | np.arange(n, dtype=np.uint64)
    rows = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    place = (np.minimum(behind[:n - window + 1], ahead[window - 1:n]) & bits).astype(np.int64)
    return place[np.diff(place, prepend=-1) != 0]


def _reach_back(x: np.ndarray, at: int, lag: int) -> int:
    """The least a with x[a:at] equal to the same stretch a lag later."""
    size = 4 * lag
    while at:
        a = max(0, at - size)
        differ = np.flatnonzero(x[a:at] != x[a + lag:at + lag])
        if len(differ):
            return a + int(differ[-1]) + 1
        at, size = a, 2 * size
    return 0


def _reach_on(x: np.ndarray, at: int, lag: int) -> int:
    """The greatest b with x[at:b] equal to the same stretch a lag later."""
    size, last = 4 * lag, len(x) - lag
    while at < last:
        b = min(last, at + size)
        differ = x[at:b] != x[at + lag:b + lag]
        if differ.any():
            return at + int(differ.argmax())
        at, size = b, 2 * size
    return last


def runs_of(x: np.ndarray, first: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, end, period) of all runs of the texts in x (see number_words), by start, then period.

    At scale s, windows of w = 2^s hashes of 2w words each: inside a run of a period q, w <= q < 2w,
    and of 4q words or more there are windows q apart, so their minima are a pair of equal ones q
    apart; as 2w words are a period or more, no equal one lies between. Each such neighbouring
    pair is extended word by word as far as the lag goes, one pair for each run and lag.
    """
    found = [(s, e, np.full(len(s), q)) for q in range(1, 1 << FIRST_SCALE)
             for s, e in [lag_runs(x, q, max(least, times * q))]]
    ends = np.append(first[1:], len(x))
    counts = ends - first - 1
    h, size, scale = mix(x.astype(np.uint64) * ODD + ODD), 1, FIRST_SCALE
    while True:
        w = 1 << scale
        # texts too short for a run of this scale are at the end
        texts = int(np.count_nonzero(counts >= times * w))
        if not texts:
            break
        whole = int(ends[texts - 1])
        while size < 2 * w:
            h = h[:whole - size + 1]
            h = mix(h[:-size] * ODD + h[size:])
            size *= 2
        h = h[:whole - size + 1]
        place = minimizers(h, w)
        by = np.argsort(h[place], kind="stable")
        equal = h[place[by]][1:] == h[place[by]][:-1]
        m, lag = place[by[:-1]][equal], np.diff(place[by])[equal]
        near = (lag >= w) & (lag < 2 * w)
        m, lag = m[near], lag[near]
        rows, past, now = [], -1, 0
        for i in np.lexsort((m, lag)).tolist():
            at, q = int(m[i]), int(lag[i])
            if q == now and at < past:
                continue
            now, past = q, _reach_on(x, at, q)
            rows.append((_reach_back(x, at, q), past + q, q))
        if rows:
            s, e, q = np.array(rows, np.int64).T
            fit = e - s >= np.maximum(least, times * q)
            found.append((s[fit], e[fit], q[fit]))
        scale += 1
    start, end, period = (np.concatenate(c) for c in zip(*found, strict=True))
    # a run is also found at multiples of its period, with the same ends
    by = np.lexsort((period, end, start))
    once = np.ones(len(by), bool)
    once[1:] = (np.diff(start[by]) != 0) | (np.diff(end[by]) != 0)
    out = np.stack([start, end, period], 1)[by[once]]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(id_col, n_words, runs, collapsed) for every row of docs, from whole texts.

    Words are what stands between ASCII white space. runs: every stretch of words with smallest
    period q, of least words and times periods or more, that no neighbouring word extends; (start,
    length, period) in words, by start, then period. collapsed: the words joined by one space, of
    each run only the first period (a word goes if any run holds it later).

    times is 4 or more: with fewer repeats a run may hold no pair of equal minimizers. Null, empty
    and short texts have no runs; rows given twice come back twice; null ids are kept. Other columns
    are not read.
    """
    if times < 4:
        raise ValueError("a run is at least four periods long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            for part in slices(batch, 1, 1 << 22):
                words = [t.split() for t in part.column(1).to_pylist()]
                x, first, order = number_words(words)
                found = runs_of(x, first, least, times)
                text = np.searchsorted(first, found[:, 0], "right") - 1
                place = np.empty(len(words), np.int64)
                place[order] = np.arange(len(words))
                a, b = np.searchsorted(text, place, "left"), np.searchsorted(text, place, "right")
                runs, left = [], []
                for k, ws in enumerate(words):
                    rows = found[a[k]:b[k]] - [first[place[k]], first[place[k]], 0]
                    runs.append([(s, e - s, q) for s, e, q in rows.tolist()])
                    if len(rows):
                        step = np.zeros(len(ws) + 1, np.int64)
                        np.add.at(step, rows[:, 0] + rows[:, 2], 1)
                        np.add.at(step, rows[:, 1], -1)
                        ws = [w for w, gone in zip(ws, np.cumsum(step).tolist(), strict=False) if not gone]
                    left.append(b" ".join(ws))
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                items = [{"start": s, "length": n, "period": q} for rs in runs for s, n, q in rs]
                offsets = np.concatenate(([0], np.cumsum([len(rs) for rs in runs]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(ws) for ws in words], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(items, kind.value_type)), pa.array(left, pa.binary())],
                    names=[id_col, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(f"`{id_col}`"), octets(text_col).alias("_octets")).mapInArrow(
        run, f"`{id_col}` {kind}, n_words long, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """The run of the greatest length over period, compared exactly; of equals the first; null if there is none."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """The rows of find_runs with counts, the strongest run and hashes in place of runs and collapsed texts."""
    best = strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    ended = F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        *(c for c in found.columns if c not in ("runs", "collapsed")), F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(ended, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
