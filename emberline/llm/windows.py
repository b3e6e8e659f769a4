"""Substring dedup over word windows: a count-min sketch tells which windows are worth grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import let_go, mix, octets, slices, stored

#: Rows of the sketch, cells of a slice of it, and the most cells of a row (a 64 MB bitmap of repeats).
DEPTH, SLICE, MOST_CELLS = 2, 1 << 20, 1 << 29
#: Most windows of a run.
LONGEST_RUN = 256
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every run of n words (empty where there are fewer), built by doubling."""
    out = []
    for odd in ODD:
        done, width, base = np.zeros(max(0, len(words) - n + 1), np.uint64), 0, mix(words + odd)
        part, size, left = base, 1, n
        while left:
            if left & 1:
                piece = part[width:width + len(done)]
                done = mix(done * odd + piece[:len(done)]) if len(done) else done
                width += size
            left >>= 1
            if left and len(part) > size:
                part = mix(part[:-size] * odd + part[size:])
            elif left:
                part = part[:0]
            size *= 2
        out.append(done)
    return out[0], out[1]


def cells_of(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(h * ODD[row] + np.uint64(row + 1)) & np.uint64(cells - 1)).astype(np.int64)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every width neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x, size = pick(x[:-size], x[size:]), 2 * size
    more = width - size
    return pick(x[:-more], x[more:]) if more else x


def least_grams(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the least hash of a gram of n // 2 words in each window of n words, those hashes by place of the grams).

    Equal windows have the same least gram, so a window that comes twice has one that comes twice. About two
    grams in n / 2 are the least of some window.
    """
    size = n // 2
    grams, _ = window_hashes(words, size)
    width = n - size + 1
    if len(grams) < width:
        return grams[:0], grams[:0]
    least = _sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    # a gram is the least of some window if the greatest of the least of its windows is its own
    return least, grams[_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == grams]


def repeated_grams(read: DataFrame, n: int) -> DataFrame:
    """(id, grams): by row of read (id, t) those least grams (see least_grams) that come more than once anywhere."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            for part in slices(batch, 1, 1 << 22):
                found = [np.unique(least_grams(word_hashes(t.split()), n)[1], return_counts=True) for t in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), [len(g) for g, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([g for g, _ in found]).view(np.int64)), pa.array(ids),
                     pa.array(np.concatenate([k for _, k in found]).astype(np.int32))], names=["gram", "id", "k"])

    grams = read.mapInArrow(choose, "gram long, id long, k int")
    often = stored(grams.groupBy("gram").agg(F.sum("k").alias("k")).where("k > 1").select("gram"))
    return grams.select("gram", "id").join(often, "gram").groupBy("id").agg(F.collect_set("gram").alias("grams"))


def gaps(sorted_cells: np.ndarray) -> bytes:
    """Ascending numbers as bytes of their gaps; 255 adds 255 and goes on."""
    steps = np.diff(sorted_cells, prepend=0)
    more, last = np.divmod(steps, 255)
    out = np.full(len(steps) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = last
    return out.tobytes()


def ungaps(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _rows_of(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list, list[list[bytes]], list[tuple], list]]:
    for batch in batches:
        for part in slices(batch, 1, 1 << 22):
            words = [t.split() for t in part.column(1).to_pylist()]
            yield (part.column(0).to_pylist(), words, [window_hashes(word_hashes(w), n) for w in words],
                   part.column(2).to_pylist() if part.num_columns > 2 else [])


def sketch(read: DataFrame, n: int, cells: int) -> np.ndarray:
    """By row of the sketch, a bitmap of the cells that windows may have met twice.

    Each task sketches its own windows (a cell counts to two) and hands out its cells by slice; a
    slice is summed over all tasks. The driver gets DEPTH * cells bits, slice by slice.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def give() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(held) if held else np.zeros(0, np.uint64)
            for row in range(DEPTH) if len(h) else ():
                c = np.sort(cells_of(h, row, cells))
                third = np.zeros(len(c), bool)
                third[2:] = c[2:] == c[:-2]
                c = c[~third]
                piece = c // SLICE
                at = np.flatnonzero(np.diff(piece, prepend=-1))
                ends = np.append(at[1:], len(c))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), row), pa.int32()), pa.array(piece[at], pa.int32()),
                     pa.array([gaps(c[a:b] - piece[a] * SLICE) for a, b in zip(at, ends, strict=True)], pa.binary())],
                    names=["row", "slice", "cells"])

        for _, _, hashes, _ in _rows_of(let_go(batches), n):
            held += [h for h, _ in hashes]
            size += sum(len(h) for h, _ in hashes)
            if size > 2_500_000:
                yield from give()
                held, size = [], 0
        yield from give()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros(0, np.uint8)

        def give() -> pa.RecordBatch:
            bits = np.packbits(counts > 1, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()),
                                               pa.array([bits], pa.binary())], names=["row", "slice", "cells"])

        for batch in let_go(batches):
            for row, piece, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row, piece) != now:
                    if now is not None:
                        yield give()
                    now, counts = (row, piece), np.zeros(min(SLICE, cells), np.uint8)
                c = ungaps(data)
                first = np.ones(len(c), bool)
                first[1:] = c[1:] != c[:-1]
                for part in (c[first], c[~first]):
                    counts[part] = np.minimum(counts[part] + 1, 2)
        if now is not None:
            yield give()

    schema = "row int, slice int, cells binary"
    merged = (read.mapInArrow(count, schema).repartition("row", "slice").sortWithinPartitions("row", "slice")
              .mapInArrow(merge, schema))
    table = np.zeros((DEPTH, cells // 8), np.uint8)
    for row, piece, bits in stored(merged).toLocalIterator():
        table[row, piece * (SLICE // 8):][:len(bits)] = np.frombuffer(bits, np.uint8)
    return table


def repeated_windows(docs: DataFrame, n: int = 20, id_col: str = "doc_id", text_col: str = "text",
                     cells: int | None = None, every: bool = False, exact: bool = False) -> DataFrame:
    """(doc, at, n): runs of n windows whose words all start earlier, by document id, then place.

    every: also those that start only later; each row counts, so a row given twice is its own copy.

    Flagged windows that follow each other go as one row, cut alike wherever the words are the same.
    A run of which an equal one comes earlier is settled as a whole; of equal runs only the first is
    taken apart into windows, which are grouped in turn. The first place of any window lies in the
    first of its equal runs, so nothing is lost by that.

    cells: cells of a sketch row, a power of two; by default about four for each window, at most
    MOST_CELLS, so that what is sent to all tasks is bounded by 2 * 64 MB at any size. A fuller
    sketch lets more single windows through to the exact grouping, and never loses a repeated one.

    exact: without a sketch, windows go on whose least gram comes more than once (see repeated_grams); nothing
    is sent to all tasks, and what goes on does not depend on how many windows there are.
    """
    spark = docs.sparkSession
    read = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), octets(text_col).alias("t"))
    if exact:
        sent, read = None, read.join(repeated_grams(read, n), "id")
    else:
        if cells is None:
            size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
            cells = min(MOST_CELLS, max(SLICE, 1 << (int(size) * 4 // 6).bit_length()))
        sent = spark.sparkContext.broadcast(sketch(read, n, cells))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None if sent is None else sent.value
        for ids, words, hashes, grams in _rows_of(let_go(batches), n):
            h = np.concatenate([a for a, _ in hashes])
            g = np.concatenate([b for _, b in hashes])
            sizes = [len(a) for a, _ in hashes]
            doc = np.repeat(np.array(ids, np.int64), sizes)
            at = np.concatenate([np.arange(s) for s in sizes])
            hit = np.ones(len(h), bool)
            if seen is None:
                hit = np.concatenate([np.isin(least_grams(word_hashes(w), n)[0], np.array(g, np.int64).view(np.uint64))
                                      for w, g in zip(words, grams, strict=True)])
            for row in range(DEPTH if seen is not None else 0):
                c = cells_of(h, row, cells)
                hit &= (seen[row, c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
            place = np.flatnonzero(hit)
            if not len(place):
                continue
            h, g, doc, at = h[hit], g[hit], doc[hit], at[hit]
            start = chunk_starts(h, np.diff(place, prepend=-2) != 1, at == 0)
            size = np.diff(np.append(start, len(h)))
            inside = np.arange(len(h), dtype=np.uint64) - np.repeat(start, size).astype(np.uint64)
            # a single window is its own key and carries nothing else
            k1, k2 = (np.where(size == 1, x[start], np.add.reduceat(mix(x + inside * ODD[0]), start)) for x in (h, g))
            doc, at = doc[start], at[start]
            # of a run that comes more than once here only the first place can be its first anywhere
            by = np.lexsort((at, doc, k2, k1))
            head = np.ones(len(by), bool)
            head[1:] = (k1[by][1:] != k1[by][:-1]) | (k2[by][1:] != k2[by][:-1])
            lead = by[np.flatnonzero(head)[np.cumsum(head) - 1]]
            later = np.zeros(len(by), bool)
            later[by] = ~head if every else ~head & ~((doc[by] == doc[lead]) & (at[by] == at[lead]))
            # a run known to come again is told by a number of windows below zero
            sign = np.ones(len(by), np.int32)
            sign[lead[~head]] = -1 if every else 1
            keep = np.zeros(len(by), bool)
            keep[by] = head
            both = np.stack([h, g], 1)
            # those are settled: they travel under a key of their own, not to where the hot run goes
            k1 = np.where(later, mix(doc.view(np.uint64) * ODD[0] + at.astype(np.uint64)), k1)
            use = np.flatnonzero(keep | later)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[use].view(np.int64)), pa.array(k2[use].view(np.int64)), pa.array(doc[use]),
                 pa.array(at[use].astype(np.int32)), pa.array(np.where(later, 1, sign)[use] * size[use].astype(np.int32)), pa.array(later[use]),
                 pa.array([b"" if later[i] or size[i] == 1 else both[start[i]:start[i] + size[i]].tobytes() for i in use.tolist()], pa.binary())],
                names=["k1", "k2", "doc", "at", "n", "sure", "hashes"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "g", "doc", "at", "n", "sure"]
        for batch in let_go(batches):
            doc, at, size, k1, k2 = (batch.column(i).to_numpy() for i in range(5))
            sure = batch.column(5).to_numpy(zero_copy_only=False)
            if sure.any():
                d, a, k = doc[sure], at[sure], size[sure]
                spread = mix(d.view(np.uint64) * ODD[0] + a.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (spread, spread, d, a, k, sure[sure])], names=names)
            if not sure.all():
                d, a, k, sign = doc[~sure], at[~sure], np.abs(size[~sure]), np.sign(size[~sure])
                inside = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                pairs = np.empty((len(inside), 2), np.int64)
                one = np.repeat(k == 1, k)
                pairs[one] = np.stack([k1, k2], 1)[~sure][k == 1]
                pairs[~one] = np.frombuffer(b"".join(batch.column(6).filter(pa.array(~sure)).to_pylist()), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(np.repeat(d, k)),
                     pa.array((np.repeat(a, k) + inside).astype(np.int32)), pa.array(np.repeat(sign, k)),
                     pa.array(np.zeros(len(pairs), bool))], names=names)

    def not_first(*key: str):
        by = Window.partitionBy(*key).orderBy("doc", "at")
        if every:
            return F.col("sure") | (F.row_number().over(by) > 1)
        return F.col("sure") | (F.struct("doc", "at") != F.first(F.struct("doc", "at")).over(by))

    def not_last(*key: str):
        return F.lead("at").over(Window.partitionBy(*key).orderBy("doc", "at")).isNotNull()

    runs = read.mapInArrow(look, "k1 long, k2 long, doc long, at int, n int, sure boolean, hashes binary")
    told = runs.withColumns({"sure": not_first("k1", "k2", "sure")} | ({"several": not_last("k1", "k2", "sure")} if every else {}))
    if every:
        # the first of several is settled too, but still meets what else holds its windows
        told = told.withColumn("n", F.when(F.col("sure"), F.abs("n")).when(F.col("several"), -F.abs("n")).otherwise(F.col("n")))
    single = told.select("doc", "at", "n", "k1", "k2", "sure", "hashes").mapInArrow(
        unpack, "h long, g long, doc long, at int, n int, sure boolean")
    if every:
        gone = (F.col("n") < 0) | not_first("h", "g", "sure") | not_last("h", "g", "sure")
        found = stored(single.withColumn("gone", gone).where("gone").select("doc", "at", F.abs("n").alias("n")))
    else:
        found = stored(single.withColumn("gone", not_first("h", "g", "sure")).where("gone").select("doc", "at", "n"))
    if sent is not None:
        sent.unpersist()
    return found


def chunk_starts(h: np.ndarray, broken: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Where runs of flagged windows are cut: at gaps, documents, and where a window's own hash says so.

    The cuts depend on the words alone, so copies of a passage are cut alike.
    """
    starts = np.flatnonzero(broken | opening | (h & np.uint64(7) == 0))
    size = np.diff(np.append(starts, len(h)))
    more = -(-size // LONGEST_RUN)
    inner = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
    return np.repeat(starts, more) + inner * LONGEST_RUN


def remove_repeats(docs: DataFrame, n: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   cells: int | None = None, texts: bool = True) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, kept) for every row of docs.

    kept is the remaining text; it is left out with texts=False.

    Every word is removed that lies in a window of n words which also starts earlier: in a document
    with a smaller id, or further left in the same one. Windows are judged on the texts as given.
    Null, empty and shorter texts lose nothing. A row given twice counts as one document and comes
    back twice; of two texts with one id neither comes before the other at the same place. A row
    with a null id is neither judged nor judged by. Other columns are not read.
    """
    found = repeated_windows(docs, n, id_col, text_col, cells)
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            for part in slices(batch, 1):
                counts, removed, digest, left = [], [], [], []
                for text, at in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = text.split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    if at:
                        first = np.array([r["at"] for r in at])
                        np.add.at(gone, first, 1)
                        np.add.at(gone, first + np.array([r["n"] for r in at]) + n - 1, -1)
                    stay = np.cumsum(gone)[:-1] == 0
                    kept = b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s] if at else words)
                    counts.append(len(words))
                    removed.append(len(words) - int(stay.sum()))
                    digest.append(hashlib.sha256(kept).hexdigest())
                    if texts:
                        left.append(kept.decode("utf-8", "replace"))
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(left, pa.string())] * texts, names=names)

    names = [id_col, "n_words", "n_removed", "kept_sha256", *["kept"] * texts]
    kind = docs.schema[id_col].dataType.simpleString()
    joined = (docs.select(id_col, octets(text_col).alias("t"))
              .join(by_doc.withColumnRenamed("doc", "_doc"), F.col(id_col) == F.col("_doc"), "left").select(id_col, "t", "at"))
    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
