"""Quality rule on repetition inside a text, read off a suffix array of its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import let_go, octets, slices

#: Signs that count as symbols; white space and the later bytes of a character.
SYMBOLS = b"#*$%&|<>"
NOT_COUNTED = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))
COLUMNS = "n_words word_chars n_symbols n_dup_lines n_repeat_words covered_words longest_repeat".split()


def suffix_ranks(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array of whole numbers, and by depth 1, 2, 4 .. the class of each place by as many numbers.

    Prefix doubling; only places that still share their class are sorted again.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    head = np.concatenate(([True], x[order][1:] != x[order][:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    depth, classes = 1, [(1, rank.copy())]
    while True:
        alone = head & np.concatenate((head[1:], [True]))
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order, classes
        at = order[open_]
        second = np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head[open_] |= new
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        depth *= 2
        classes.append((depth, rank.copy()))


def repeat_lengths(x: np.ndarray, least: int) -> np.ndarray:
    """For each place the length of the longest run from it that also starts elsewhere (0 below least).

    It is the larger common prefix with the suffix before and after in the suffix array: the value
    of the deepest common-prefix interval that holds the suffix.
    """
    n = len(x)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order, classes = suffix_ranks(x)
    shared = next(((d, c) for d, c in reversed(classes) if d <= least), classes[0])
    pairs = np.flatnonzero(shared[1][order[1:]] == shared[1][order[:-1]])
    a, b = order[pairs], order[pairs + 1]
    length = np.zeros(len(pairs), np.int64)
    for depth, kind in reversed(classes):
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = kind[a[inside]] == kind[b[inside]]
        length += np.where(same, depth, 0)
        a, b = a + np.where(same, depth, 0), b + np.where(same, depth, 0)
    np.maximum.at(out, order[pairs], length)
    np.maximum.at(out, order[pairs + 1], length)
    out[out < least] = 0
    return out


def covered(lengths: np.ndarray) -> np.ndarray:
    """Places inside the union of the spans [i, i + lengths[i])."""
    n = len(lengths)
    i = np.arange(n)
    return np.maximum.accumulate(np.where(lengths > 0, i + lengths, 0)) > i


def measure(texts: list[bytes], window: int, span: int) -> np.ndarray:
    """A row of COLUMNS for each text, all texts through one suffix array."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in ws), np.int64, int(counts.sum()))
    doc = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    # texts keep apart: a number belongs to its text, and one number of its own ends each text
    x = np.empty(len(flat) + len(texts), np.int64)
    stops = ends + np.arange(len(texts))
    inner = np.ones(len(x), bool)
    inner[stops] = False
    x[inner] = doc * (len(ids) + 1) + flat
    x[stops] = (np.arange(len(texts)) + 1) * (len(ids) + 1) - 1
    lengths = repeat_lengths(x, window)
    at_window = covered(lengths)
    at_span = covered(np.where(lengths >= span, lengths, 0))
    starts = np.concatenate(([0], stops[:-1] + 1)) if len(texts) else np.zeros(0, np.int64)
    out = np.zeros((len(texts), len(COLUMNS)), np.int64)
    out[:, 0] = counts
    if len(texts):
        out[:, 4] = np.add.reduceat(at_window.astype(np.int64), starts)
        out[:, 5] = np.add.reduceat(at_span.astype(np.int64), starts)
        out[:, 6] = np.maximum.reduceat(lengths, starts)
    for k, t in enumerate(texts):
        lines = [line for line in t.split(b"\n") if line.strip()]
        out[k, 1] = len(t.translate(None, NOT_COUNTED))
        out[k, 2] = len(t) - len(t.translate(None, SYMBOLS))
        out[k, 3] = len(lines) - len(set(lines))
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, span: int = 16,
          share: float = 0.2, longest: int = 50, min_words: int = 20, base_share: float = 0.3) -> DataFrame:
    """docs with COLUMNS, base_failed and kept, from whole texts; no row is dropped.

    covered_words: words in the union of all repeated runs of span or more words (maximal repeats
    cover the same words). kept is false where base_failed, where they are more than share of the
    words, or where the longest repeat has more than longest words. Null, empty and word-less texts
    fail the base. Input columns named like an output are replaced; the other columns are kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            at = batch.num_columns - 1
            for part in slices(batch, at, 1 << 21):
                out = measure(part.column(at).to_pylist(), window, span)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], *(pa.array(out[:, k]) for k in range(len(COLUMNS)))],
                    names=[*part.schema.names[:at], *COLUMNS])

    mine = {*COLUMNS, "base_failed", "kept", "_octets"} - {text_col}
    plain = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine), octets(text_col).alias("_octets"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    found = plain.mapInArrow(run, ", ".join(filter(None, [schema, *(f"{c} long" for c in COLUMNS)])))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > round(100 * base_share) * F.col("n_words"))
    return (found.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed")
                        & (100 * F.col("covered_words") <= round(100 * share) * F.col("n_words"))
                        & (F.col("longest_repeat") <= longest)))
