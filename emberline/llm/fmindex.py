"""Benchmark decontamination: an FM-index over the words of each shard of documents, searched backwards."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import let_go, octets, slices, stored

#: Text bytes of a shard (a longer document is a shard of its own); every which text place is sampled;
#: bytes of benchmark text that are sent to all tasks at once; windows of a piece of it.
SHARD, SAMPLE, BLOCK, PIECE = 1 << 22, 16, 1 << 22, 4096
SPANS = "array<struct<start: long, end: long>>"
PAIRS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: Bytes that separate words once A-Z is lower case.
SPACES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(SPACES).split()


def suffix_order(x: np.ndarray) -> np.ndarray:
    """The suffixes of x in order, by prefix doubling from three symbols on; only ties are sorted again.

    x ends with a symbol that comes nowhere else and is less than all others.
    """
    n = len(x)
    bits = int(x.max()).bit_length() if n else 0
    depth = min(3, 62 // max(bits, 1))
    key = x.astype(np.int64)
    for d in range(1, depth):
        key = key << bits
        key[:n - d] |= x[d:]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    head = np.ones(n, bool)
    head[1:] = key[order][1:] != key[order][:-1]
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(open_):
            return order
        at = order[open_]
        # suffixes that tie here go on, as the last symbol comes once
        key = rank[at] * n + rank[at + depth]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        head[open_] |= new
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        depth *= 2


class Bits:
    """A row of bits with rank: counts by 64 places and the bits themselves."""

    def __init__(self, flags: np.ndarray):
        n = len(flags)
        whole = np.zeros((n // 64 + 1) * 64, bool)
        whole[:n] = flags
        self.words = np.packbits(whole, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below).astype(np.int64)


class Wavelets:
    """A row of symbols as one row of bits for each bit of a symbol, highest first; zeros go before ones."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels, self.zeros = [], []
        at = symbols
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (at >> bit) & 1 > 0
            self.levels.append((bit, Bits(ones)))
            self.zeros.append(int(len(at) - ones.sum()))
            at = np.concatenate([at[~ones], at[ones]])
        # where the run of each symbol starts in the last arrangement
        self.start = np.zeros(top + 2, np.int64)
        by = np.flatnonzero(np.diff(at, prepend=-1) != 0)
        self.start[at[by]] = by

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol comes among the first i."""
        for (bit, row), zeros in zip(self.levels, self.zeros, strict=True):
            ones = row.ones(i)
            i = np.where((symbol >> bit) & 1 > 0, zeros + ones, i - ones)
        return i - self.start[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it comes before."""
        symbol = np.zeros(len(i), np.int64)
        for (bit, row), zeros in zip(self.levels, self.zeros, strict=True):
            ones, here = row.ones(i), row.get(i)
            symbol |= here.astype(np.int64) << bit
            i = np.where(here, zeros + ones, i - ones)
        return symbol, i - self.start[symbol]


class Index:
    """The words of some documents, ready for backward search: wavelets of the last column, counts, samples."""

    def __init__(self, texts: list[list[bytes]]):
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        # 0 ends the row of all words, 1 each document
        ids: dict[bytes, int] = {}
        flat = np.fromiter((ids.setdefault(w, len(ids) + 2) for ws in texts for w in ws), np.int64, int(counts.sum()))
        stops = np.cumsum(counts) + np.arange(len(texts))
        x = np.zeros(len(flat) + len(texts) + 1, np.int64)
        inner = np.ones(len(x), bool)
        inner[stops], inner[-1] = False, False
        x[inner], x[stops] = flat, 1
        order = suffix_order(x)
        top = len(ids) + 1
        self.ids, self.size = ids, len(x)
        self.first = np.concatenate(([0], stops + 1))
        self.last = Wavelets(x[order - 1], top)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(x, minlength=top + 1))))
        sampled = order % SAMPLE == 0
        self.sampled, self.samples = Bits(sampled), (order[sampled] // SAMPLE).astype(np.int32)

    def find(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, lo, hi as rows): the rows of suffixes that start with each phrase, from its last word back.

        phrases: a row of symbols each, the words at the right end, length of them.
        """
        rows, width = np.arange(len(phrases)), phrases.shape[1]
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        for back in range(1, width + 1):
            on = np.flatnonzero(length >= back)
            if not len(on):
                break
            symbol = phrases[rows[on], width - back]
            both = self.last.rank(np.concatenate([symbol, symbol]), np.concatenate([lo[on], hi[on]]))
            lo[on], hi[on] = self.below[symbol] + both[:len(on)], self.below[symbol] + both[len(on):]
            left = lo < hi
            rows, lo, hi, length = rows[left], lo[left], hi[left], length[left]
        return rows, np.stack([lo, hi], 1)

    def places(self, row: np.ndarray) -> np.ndarray:
        """Where the suffixes of those rows start: back through the text to the next sampled place."""
        out, open_, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(open_):
            hit = self.sampled.get(row)
            out[open_[hit]] = self.samples[self.sampled.ones(row[hit])].astype(np.int64) * SAMPLE + steps
            open_, row = open_[~hit], row[~hit]
            symbol, before = self.last.access(row)
            row, steps = self.below[symbol] + before, steps + 1
        return out


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ids, copies, index): a row for each shard of documents, with its FM-index; to be stored and searched.

    Equal texts of a shard are indexed once: copies names the indexed text of each id. A document
    lies in one shard. Null texts have no words. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            for part in slices(batch, 1, SHARD):
                number: dict[bytes, int] = {}
                copies = [number.setdefault(t, len(number)) for t in part.column(1).to_pylist()]
                index = Index([words_of(t) for t in number])
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)),
                     pa.array([copies], pa.list_(pa.int32())), pa.array([pickle.dumps(index, 5)], pa.binary())],
                    names=["ids", "copies", "index"])

    return docs.select(F.col(f"`{id_col}`"), octets(text_col).alias("_octets")).mapInArrow(
        run, f"ids array<{kind}>, copies array<int>, index binary")


class Phrases:
    """The different windows of n words of some texts, as rows of word numbers, and the items that hold each.

    A text of fewer words, but not none, is one window; it stands at the right end of its row, after -1.
    """

    def __init__(self, texts: list[tuple[str | None, bytes]], n: int):
        ids: dict[bytes, int] = {}
        names: dict[str | None, int] = {}
        parts, owners = [np.zeros((0, n), np.int32)], [np.zeros(0, np.int64)]
        for item, text in texts:
            row = np.array([ids.setdefault(w, len(ids)) for w in words_of(text)], np.int32)
            if len(row):
                row = np.concatenate([np.full(max(0, n - len(row)), -1, np.int32), row])
                parts.append(np.lib.stride_tricks.sliding_window_view(row, n))
                owners.append(np.full(len(parts[-1]), names.setdefault(item, len(names))))
        self.rows, which = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
        self.width = (self.rows >= 0).sum(1)
        self.words, self.names = list(ids), list(names)
        held = np.unique(which.ravel() * max(1, len(names)) + np.concatenate(owners))
        self.holder = held % max(1, len(names))
        self.ends = np.searchsorted(held // max(1, len(names)), np.arange(len(self.rows) + 1))

    def occurrences(self, index: Index) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place) of every occurrence in the words of a shard."""
        there = np.array([index.ids.get(w, 0) for w in self.words] + [0], np.int64)
        symbols = there[self.rows]
        known = np.flatnonzero(((symbols > 0) | (self.rows < 0)).all(1))
        if not len(known):
            return known, known
        found, between = index.find(symbols[known], self.width[known])
        rows = _spread(between[:, 0], between[:, 1])
        return np.repeat(known[found], between[:, 1] - between[:, 0]), index.places(rows)

    def items(self, text: np.ndarray, phrase: np.ndarray) -> dict[int, list[str]]:
        """By text the ids of the items that hold its phrases, ordered, each once."""
        pairs = np.unique(text * len(self.rows) + phrase)
        text, phrase = np.divmod(pairs, max(1, len(self.rows)))
        size = self.ends[phrase + 1] - self.ends[phrase]
        owner = self.holder[_spread(self.ends[phrase], self.ends[phrase + 1])]
        out: dict[int, list[str]] = defaultdict(list)
        once = np.unique(np.repeat(text, size) * max(1, len(self.names)) + owner)
        for t, k in zip(*(c.tolist() for c in np.divmod(once, max(1, len(self.names)))), strict=True):
            if self.names[k] is not None:
                out[t].append(self.names[k])
        return {t: sorted(names) for t, names in out.items()}


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges lo to hi, one range after another."""
    size = hi - lo
    return np.arange(int(size.sum())) + np.repeat(lo - np.cumsum(size) + size, size)


def _spans(index: Index, at: np.ndarray, width: np.ndarray) -> dict[int, list[dict]]:
    """By text the merged runs of its words that the stretches cover."""
    step = np.zeros(index.size + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    edge = np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(index.first, start, "right") - 1
    out: dict[int, list[dict]] = defaultdict(list)
    for t, s, e in zip(text.tolist(), (start - index.first[text]).tolist(), (end - index.first[text]).tolist(), strict=True):
        out[t].append({"start": s, "end": e})
    return out


def pieces(items: DataFrame, n: int, item_col: str, text_col: str, most: int = PIECE) -> DataFrame:
    """(item, t): the words of each item in pieces that hold at most `most` windows, so that every window is in one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            rows = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                rows += [(item, b" ".join(words[i:i + most + n - 1])) for i in range(0, max(1, len(words) - n + 1), most) if words]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())],
                                             names=["item", "t"])

    return items.select(F.col(f"`{item_col}`").cast("string").alias("item"), octets(text_col).alias("t")).mapInArrow(
        run, "item string, t binary")


def search(indexes: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", item_col: str = "item_id",
           text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id_col, n_words, spans, items) for every document of the indexes (see build).

    spans: merged runs of words (start, end) that lie in any occurrence of a window of n words of an
    item; an item with fewer words, but not none, is one window. items: the ids, as ordered texts, of
    the items that have one. Words are runs of 0-9, a-z and signs beyond ASCII, after A-Z became
    lower case. Null and word-less texts have no words and no windows; an item without an id marks
    words and is not listed; an id given twice is listed once; documents given twice or without an
    id come back as given. Other columns are not read.

    Up to about block bytes of items go to all tasks at once. Beyond that their windows are dealt into
    blocks, the written indexes are searched once for each, and a document's answers are merged.
    """
    cut = stored(pieces(items, n, item_col, text_col))
    size = cut.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block))
    if blocks == 1:
        return _pass(indexes.withColumn("shard", F.lit(None).cast("string")), cut, n, id_col).drop("shard", "row")
    indexes = stored(indexes.withColumn("shard", F.expr("uuid()")))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("item", "t"), F.lit(blocks)))
    answers = [stored(_pass(indexes, dealt.where(F.col("block") == b), n, id_col)) for b in range(blocks)]
    whole = answers[0]
    for one in answers[1:]:
        whole = whole.unionByName(one)
    kind = indexes.schema["ids"].dataType.elementType.simpleString()
    together = whole.groupBy("shard", "row").agg(
        F.first(f"`{id_col}`").alias(id_col), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            spans = pa.array([merged(s) for s in batch.column(2).to_pylist()], PAIRS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans, batch.column(3)], names=batch.schema.names)

    return together.select(F.col(f"`{id_col}`"), "n_words", "spans", "items").mapInArrow(
        merge, f"`{id_col}` {kind}, n_words long, spans {SPANS}, items array<string>")


def merged(spans: list[dict]) -> list[dict]:
    """Spans in order, those that touch or overlap as one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _pass(indexes: DataFrame, cut: DataFrame, n: int, id_col: str) -> DataFrame:
    """The answers of one block of pieces, with the place of each document in the indexes."""
    sent = indexes.sparkSession.sparkContext.broadcast(Phrases([(r.item, bytes(r.t)) for r in cut.select("item", "t").collect()], n))
    kind = indexes.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        for batch in let_go(batches):
            for k in range(batch.num_rows):
                index = pickle.loads(batch.column(2)[k].as_py())
                phrase, at = phrases.occurrences(index)
                spans = _spans(index, at, phrases.width[phrase])
                said = phrases.items(np.searchsorted(index.first, at, "right") - 1, phrase)
                copies, words = batch.column(1)[k].as_py(), np.diff(index.first) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[k].values, pa.array(words[copies], pa.int64()),
                     pa.array([spans.get(c, []) for c in copies], PAIRS),
                     pa.array([said.get(c, []) for c in copies], pa.list_(pa.string())),
                     pa.array([batch.column(3)[k].as_py()] * len(copies), pa.string()), pa.array(range(len(copies)), pa.int32())],
                    names=[id_col, "n_words", "spans", "items", "shard", "row"])

    return indexes.select("ids", "copies", "index", "shard").mapInArrow(
        run, f"`{id_col}` {kind}, n_words long, spans {SPANS}, items array<string>, shard string, row int")


def digests(found: DataFrame) -> DataFrame:
    """The rows of search with numbers and a hash in place of spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        *(c for c in found.columns if c not in ("spans", "items")), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
