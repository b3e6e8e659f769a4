"""The word FM-index against plain search for every window."""

import random
import re

import numpy as np
import pytest

from emberline.llm import fmindex
from emberline.llm.common import stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_plain(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, n=10):
    windows = set()
    for item, text in items:
        w = words_plain(text)
        windows |= {(tuple(w[i:i + n]), item) for i in range(max(1, len(w) - n + 1)) if w}
    out = []
    for i, text in docs:
        w, hit, said = words_plain(text), set(), set()
        for p, item in windows:
            for at in range(len(w) - len(p) + 1):
                if tuple(w[at:at + len(p)]) == p:
                    hit |= set(range(at, at + len(p)))
                    said |= {str(item)} if item is not None else set()
        edges = sorted(h for h in hit if h - 1 not in hit), sorted(h + 1 for h in hit if h + 1 not in hit)
        out.append((i, len(w), list(zip(*edges, strict=True)), sorted(said)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark, texts, words):
    rng = random.Random(9)
    rows = [(1, texts[9][:600]), (2, "one"), (3, "Two, WORDS!"), (4, None), (5, " .. "), (6, "same line here"), (None, texts[10][900:1400]),
            (7, texts[9][100:700]), (7, texts[9][100:700]), (7, "x" * 5000), (10, "Shti " * 30), (11, " ".join(rng.choice(words) for _ in range(90)))]
    return rows, spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "item_id long, text string, item string, shard int")


def test_matches_plain_search(odd_docs, items):
    rows, df = items
    want = plain([(r.doc_id, r.text) for r in odd_docs.collect()], rows)
    assert found(fmindex.search(fmindex.build(odd_docs), df)) == want
    assert sum(bool(w[2]) for w in want) > 5


def test_blocks_give_the_same(odd_docs, items):
    rows, df = items
    index = stored(fmindex.build(odd_docs))
    assert found(fmindex.search(index, df, block=2000)) == found(fmindex.search(index, df))


def test_long_items_go_in_pieces(spark, items):
    rows, df = items
    cut = fmindex.pieces(df, 10, "item_id", "text", most=7)
    sets = {}
    for part in (cut, fmindex.pieces(df, 10, "item_id", "text")):
        p = fmindex.Phrases([(r.item, bytes(r.t)) for r in part.collect()], 10)
        sets[part] = {(tuple(p.words[k] for k in row if k >= 0), p.names[o]) for i, row in enumerate(p.rows.tolist())
                      for o in p.holder[p.ends[i]:p.ends[i + 1]].tolist()}
    one, two = sets.values()
    assert one == two and max(len(bytes(r.t).split()) for r in cut.collect()) == 16


def test_empty_tables(spark, no_docs, items):
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert fmindex.search(fmindex.build(no_docs), items[1]).count() == 0
    docs = spark.createDataFrame([("a", "some words"), ("b", None)], "doc_id string, text string")
    assert found(fmindex.search(fmindex.build(docs), no_items)) == [("a", 2, [], []), ("b", 0, [], [])]


def test_index_counts_and_places():
    rng = random.Random(4)
    texts = [[bytes([97 + rng.randrange(3)]) for _ in range(rng.randint(0, 60))] for _ in range(30)] + [[b"a"] * 300] * 3
    index = fmindex.Index(texts)
    flat = [w for t in texts for w in [*t, None]]
    for _ in range(200):
        p = [bytes([97 + rng.randrange(3)]) for _ in range(rng.randint(1, 6))]
        symbols = np.array([[index.ids.get(w, 0) for w in p]])
        rows, between = index.find(symbols, np.array([len(p)]))
        want = [i for i in range(len(flat)) if flat[i:i + len(p)] == p]
        got = sorted(index.places(np.arange(*between[0])).tolist()) if len(rows) else []
        assert got == want


def test_suffix_order():
    rng = np.random.default_rng(5)
    for top in (2, 3, 50, 1 << 21):
        x = np.append(rng.integers(1, top, 400), 0)
        x[:200] = x[100:300]
        want = sorted(range(len(x)), key=lambda i: x[i:].tolist())
        assert fmindex.suffix_order(x).tolist() == want
