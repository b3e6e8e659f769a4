"""Periodic runs of words against a scan of every lag."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from emberline.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def runs_plain(words, least=6, times=4):
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, times * q):
                out.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed_plain(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def repeating(rng, letters):
    out = []
    while rng.random() < 0.8:
        block = [rng.randrange(letters) for _ in range(rng.randint(1, 40))]
        out += [block[i % len(block)] for i in range(rng.randint(1, 9 * len(block)))]
        out += [rng.randrange(letters) for _ in range(rng.randint(0, 20))]
    return [str(x).encode() for x in out]


@pytest.mark.parametrize("letters", [1, 2, 3, 60])
def test_runs_match_a_scan_of_every_lag(letters):
    rng = random.Random(letters)
    for _ in range(20):
        texts = [repeating(rng, letters) for _ in range(rng.randint(1, 8))]
        x, first, order = periodic.number_words(texts)
        found = periodic.runs_of(x, first)
        for k, i in enumerate(order.tolist()):
            a, b = first[k], first[k] + len(texts[i])
            here = found[(found[:, 0] >= a) & (found[:, 0] <= b)]
            assert [(s - a, e - s, q) for s, e, q in here.tolist()] == runs_plain(texts[i])


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 15, 16, 17, 31, 64, 300])
def test_shortest_runs_at_scale_edges(period):
    block = list(range(period))
    for n, there in ((max(6, 4 * period), True), (max(6, 4 * period) - 1, False)):
        words = [b"w%d" % block[i % period] for i in range(n)]
        x, first, _ = periodic.number_words([[b"before", *words, b"after"]])
        assert periodic.runs_of(x, first).tolist() == ([[1, n + 1, period]] if there else [])


def test_one_word_a_million_times():
    x, first, _ = periodic.number_words([[b"a"] * 1_000_000, [b"a", b"b"] * 300_000])
    assert periodic.runs_of(x, first).tolist() == [[0, 1_000_000, 1], [1_000_001, 1_600_001, 2]]


def test_rows_and_odd_texts(odd_docs, no_docs):
    got = periodic.find_runs(odd_docs).collect()
    want = []
    for r in odd_docs.collect():
        words = (r.text or "").encode().split()
        runs = runs_plain(words)
        want.append((r.doc_id, len(words), runs, collapsed_plain(words, runs).decode()))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)
    assert any(runs for _, _, runs, _ in want)
    empty = periodic.digests(periodic.find_runs(no_docs))
    assert empty.count() == 0 and "runs_sha256" in empty.columns


def test_few_repeats_are_refused(no_docs):
    with pytest.raises(ValueError):
        periodic.find_runs(no_docs, times=3)


def test_query_plants_and_digests(spark):
    texts = {r.doc_id: (r.text or "").encode().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op11_periodic_runs(spark, SF).collect():
        words, h = texts[r.doc_id], zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_plain(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed_plain(words, runs)).hexdigest()


def test_null_ids_are_not_planted(spark):
    docs = spark.createDataFrame([(None, "a b  c"), (None, None)], "doc_id long, text string")
    assert sorted((r.text for r in queries.planted(docs).collect()), key=repr) == ["a b  c", None]


def test_minimizers_are_window_minima():
    h = np.random.default_rng(3).integers(0, 1 << 63, 500).astype(np.uint64)
    for w in (1, 8, 64, 500):
        want = sorted({i + int(h[i:i + w].argmin()) for i in range(len(h) - w + 1)})
        assert periodic.minimizers(h, w).tolist() == want
    assert len(periodic.minimizers(h, 501)) == 0
