"""SimHash near-duplicates found at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import let_go, octets, signed, stored
from emberline.llm.components import components

#: Bits of a fingerprint in each block; the first two hold the perfect binary
#: [23, 12] code (radius 3), the third a [15, 11] code (radius 1) beside three plain bits.
BLOCKS = (23, 23, 18)
GOLAY = 0b101011100011
HAMMING = 0b10011


def _fingerprint(text: bytes, words: int) -> int:
    """Majority bits over the hashes of all shingles; 0 without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-words] + 1))
    cuts = map(line.__getitem__, map(slice, starts.tolist(), ends[words - 1:].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(42)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.flatnonzero(2 * counts > len(hashes)).tolist()
    return sum(1 << b for b in bits)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id_col, fp long) for every row of docs, from its whole text; a null text has fp 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            fps = np.fromiter((_fingerprint(t, words) for t in batch.column(1).to_pylist()),
                              np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(fps)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, octets(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


class Cyclic:
    """Nearest word of a perfect cyclic code, by syndrome."""

    def __init__(self, length: int, poly: int, radius: int):
        self.length, self.degree = length, poly.bit_length() - 1
        one = [self._rest(1 << i, poly) for i in range(length)]
        half = length // 2
        self.low_bits = half
        self.low = self._table(one[:half])
        self.high = self._table(one[half:])
        self.error = np.zeros(1 << self.degree, np.uint64)
        for weight in range(1, radius + 1):
            for places in combinations(range(length), weight):
                syndrome = 0
                for p in places:
                    syndrome ^= one[p]
                self.error[syndrome] = sum(1 << p for p in places)

    @staticmethod
    def _rest(value: int, poly: int) -> int:
        degree = poly.bit_length() - 1
        while value.bit_length() > degree:
            value ^= poly << (value.bit_length() - 1 - degree)
        return value

    @staticmethod
    def _table(rests: list[int]) -> np.ndarray:
        table = np.zeros(1, np.int64)
        for r in rests:
            table = np.concatenate((table, table ^ r))
        return table

    def anchor(self, x: np.ndarray) -> np.ndarray:
        """The information bits of the code word nearest to each x."""
        low = x & np.uint64((1 << self.low_bits) - 1)
        syndrome = self.low[low.astype(np.int64)] ^ self.high[(x >> np.uint64(self.low_bits)).astype(np.int64)]
        return (x ^ self.error[syndrome]) >> np.uint64(self.degree)


def _coders():
    golay, hamming = Cyclic(23, GOLAY, 3), Cyclic(15, HAMMING, 1)

    def third(x: np.ndarray) -> np.ndarray:
        return hamming.anchor(x & np.uint64(0x7FFF)) << np.uint64(3) | x >> np.uint64(15)

    return golay.anchor, golay.anchor, third


def _near(x: np.ndarray, bits: int, code, flips: int) -> list[np.ndarray]:
    """By number of flipped bits, the anchors of all words that many bits from x."""
    out = []
    for n in range(flips + 1):
        masks = [sum(1 << p for p in places) for places in combinations(range(bits), n)]
        out.append(np.stack([code(x ^ np.uint64(m)) for m in masks], 1))
    return out


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the anchors at which each fingerprint is to be compared.

    Of three blocks, two differ together in at most 2/3 of the threshold. A word midway between two
    fingerprints on those blocks lies within half of that from either, so its nearest code word (an
    anchor within the covering radius plus that half) is a key of both.
    """
    flips = (2 * threshold // 3 + 1) // 2
    rows, keys = [], []
    near, shift = [], 0
    for bits, code in zip(BLOCKS, _coders(), strict=True):
        near.append(_near(fps >> np.uint64(shift) & np.uint64((1 << bits) - 1), bits, code, flips))
        shift += bits
    for pair, (i, j) in enumerate(combinations(range(3), 2)):
        both = np.concatenate([(near[i][n][:, :, None] << np.uint64(20) | near[j][m][:, None, :]).reshape(len(fps), -1)
                               for n in range(flips + 1) for m in range(flips + 1 - n)], 1)
        both.sort(1)
        first = np.ones(both.shape, bool)
        first[:, 1:] = both[:, 1:] != both[:, :-1]
        r, c = np.nonzero(first)
        rows.append(r)
        keys.append(both[r, c] | np.uint64(pair << 60))
    return np.concatenate(rows), np.concatenate(keys)


def _forest(f: np.ndarray, threshold: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span the components of one group: every found row scans only rows not yet found."""
    a, b, open_ = [], [], f
    while len(open_) > 1:
        front, open_ = [open_[0]], open_[1:]
        while front and len(open_):
            x = front.pop()
            hit = np.bitwise_count(open_ ^ x) <= threshold
            if hit.any():
                found, open_ = open_[hit], open_[~hit]
                a.append(np.full(len(found), x))
                b.append(found)
                front.extend(found)
    return a, b


def _links(keys: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: pairs of short runs directly, long runs by a spanning walk."""
    cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], 1)) + 1 if len(keys) else np.zeros(0, int)
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    size = ends - starts
    a, b = [], []
    for d in range(1, 8):
        s = starts[(size > d) & (size <= 8)]
        e = ends[(size > d) & (size <= 8)]
        if not len(s):
            break
        n = e - s - d
        i = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = np.bitwise_count(fps[i] ^ fps[i + d]) <= threshold
        a.append(fps[i[hit]])
        b.append(fps[i[hit] + d])
    for s, e in zip(starts[size > 8].tolist(), ends[size > 8].tolist(), strict=True):
        x, y = _forest(fps[s:e], threshold)
        a += x
        b += y
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def links(fps: DataFrame, threshold: int = 4, block_rows: int = 20_000) -> DataFrame:
    """(a, b) links that span all components of distinct long fingerprints in column fp.

    A pair at threshold or fewer bits meets at an anchor. An anchor with more than block_rows
    fingerprints is dealt out as pairs of blocks, so no task holds more than two blocks of it.
    """
    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            for at in range(0, batch.num_rows, 4096):
                f = batch.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                rows, keys = anchors(f, threshold)
                yield pa.RecordBatch.from_arrays([signed(keys), signed(f[rows])], names=["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in let_go(batches):
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            held_k = np.concatenate((held_k, k))
            held_f = np.concatenate((held_f, batch.column(2).to_numpy().view(np.uint64)))
            same = np.all(held_k == held_k[-1], 1)
            cut = len(same) - (len(same) if same.all() else int(np.argmin(same[::-1])))
            if cut:
                a, b = _links(held_k[:cut], held_f[:cut], threshold)
                held_k, held_f = held_k[cut:], held_f[cut:]
                yield pa.RecordBatch.from_arrays([signed(a), signed(b)], names=["a", "b"])
        a, b = _links(held_k, held_f, threshold)
        yield pa.RecordBatch.from_arrays([signed(a), signed(b)], names=["a", "b"])

    keyed = fps.select("fp").mapInArrow(replicate, "key long, fp long")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a fingerprint becomes hundreds of rows, which Spark's estimate of keyed does not know: neither side may be broadcast by it
    dealt = (keyed.join(shared.hint("merge"), "key").withColumn("blocks", blocks)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("own", own)
             .select("key", (F.least("own", "other").cast("long") * 1_000_000 + F.greatest("own", "other"))
                     .alias("part"), "fp"))
    parts = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    return parts.mapInArrow(compare, "a long, b long")


def _placed(known: DataFrame, threshold: int) -> DataFrame:
    """(fp, root) for every fingerprint in known."""
    distinct = known.select("fp").distinct()
    roots = components(links(distinct, threshold), "a", "b")
    return (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                    threshold: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs.

    Fingerprints at threshold or fewer differing bits link; component_id is the smallest id that the
    row reaches. Texts without words (null or empty too) have fingerprint zero and link like any
    other. Repeated rows come back as often as given; a null id is never a component's id unless the
    component has no other. Columns other than the two are not read.
    """
    known = stored(fingerprints(docs, id_col, text_col, words))
    placed = _placed(known, threshold)
    distinct = known.groupBy("fp").agg(F.min(id_col).alias("least"))
    named = distinct.join(placed, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(named, "root").select("fp", "component_id")
    # every fp has its row; a left join never broadcasts known, whose files may be small for its rows
    return (known.join(by_fp, "fp", "left")
            .select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def one_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that come first in their group; rows: (key struct of id and text hash th, root) for each of docs.

    The names this needs beside the columns of docs differ from all of them.
    """
    base = "_" * (1 + max((len(c) for c in docs.columns), default=0))
    chosen, hashed, rows_, th = (base + x for x in ("chosen", "hash", "rows", "th"))
    counted = rows.groupBy("root", "key").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("root").agg(F.min(F.struct(
        F.col("key.id").isNull().alias("none"), F.col("key.id").alias("id"), F.col("key.th").alias("th"), "n")).alias("c"))
    named = first.select(F.col("c.id").alias(chosen), F.col("c.th").alias(hashed), F.col("c.n").alias(rows_))
    kept = (docs.withColumn(th, F.xxhash64(octets(text_col)))
            .join(named, F.col(id_col).eqNullSafe(F.col(chosen)) & (F.col(th) == F.col(hashed))).drop(chosen, hashed))
    once = kept.where(F.col(rows_) == 1).drop(rows_, th)
    return once.unionByName(kept.where(F.col(rows_) > 1).dropDuplicates([id_col, th]).drop(rows_, th))


def first_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                   threshold: int = 4) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest id.

    A null id comes after all others; of different texts with the smallest id the one of least hash
    stays, of equal rows any one. All columns are kept.
    """
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(octets(text_col)).alias("th")).alias("key"),
                        F.col(text_col).alias("text"))
    known = stored(fingerprints(keyed, "key", "text", words))
    return one_of_each(docs, known.join(_placed(known, threshold), "fp", "left").select("key", "root"), id_col, text_col)
