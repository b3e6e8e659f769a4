"""Byte-exact repeated passages by a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import let_go, mix, octets, slices, stored

#: Bytes of the gram that an anchor is chosen by; the odd base of the rolling hash; bytes hashed at once.
GRAM, BASE, BLOCK = 64, 0x9E3779B97F4A7C15 | 1, 1 << 18
#: Contexts of a new batch; contexts after which a task starts a new family at the next key; contexts
#: of one key beyond which the key is dealt out by whole strings instead.
BATCH, FAMILY, CROWD = 4096, 65_536, 16_384


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


UP, DOWN = _powers(BLOCK + 8192)


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, at, lo, hi): places of a text that stand for its length-byte strings.

    Each string is represented by its gram of least hash, the leftmost of equals, so equal strings
    have their anchor at the same distance from their start. at is the anchor's place, key the hash
    of its gram; the strings that it stands for start lo to hi bytes before it.
    """
    reach = length - GRAM + 1
    out = []
    for start in range(0, len(text) - length + 1, BLOCK):
        b = np.frombuffer(text[start:start + BLOCK + length - 1], np.uint8)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * UP[:len(b)], out=sums[1:])
        v = mix((sums[GRAM:] - sums[:-GRAM]) * DOWN[:len(b) - GRAM + 1])
        n = len(v)
        ranked = (v & ~np.uint64(0xFFFFF)) | np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // reach) * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:n] = ranked
        rows = padded.reshape(-1, reach)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        windows = n - reach + 1
        place = (np.minimum(behind[:windows], ahead[reach - 1:reach - 1 + windows]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], windows) - 1
        at = place[first]
        out.append((v[at].view(np.int64), at + start, at - last, at - first))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Level:
    """A suffix array: what follows the anchors, in order, and what precedes them, backwards, in order."""

    def __init__(self, key, right, left, lo, hi, ids, by_left):
        self.key, self.right, self.left, self.lo, self.hi, self.ids, self.by_left = key, right, left, lo, hi, ids, by_left

    def __len__(self) -> int:
        return len(self.ids)

    @classmethod
    def build(cls, key: np.ndarray, contexts: list[bytes], lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, length: int) -> Level:
        right = np.array([c[h:h + length] for c, h in zip(contexts, hi.tolist(), strict=True)], f"S{length}")
        left = np.array([c[:h][::-1] for c, h in zip(contexts, hi.tolist(), strict=True)], f"S{length}")
        order = np.argsort(right, kind="stable")
        left = left[order]
        return cls(key[order], right[order], left, lo[order], hi[order], ids[order], np.argsort(left, kind="stable"))

    def part(self, chosen: np.ndarray) -> Level:
        new = np.cumsum(chosen) - 1
        return Level(self.key[chosen], self.right[chosen], self.left[chosen], self.lo[chosen], self.hi[chosen],
                     self.ids[chosen], new[self.by_left[chosen[self.by_left]]])

    def merge(self, other: Level) -> Level:
        """Both in one order, by a linear merge of either order."""
        mine, theirs = _merged(self.right, other.right)

        def put(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.empty(len(a) + len(b), a.dtype)
            out[mine], out[theirs] = a, b
            return out

        a, b = _merged(self.left[self.by_left], other.left[other.by_left])
        by_left = np.empty(len(self) + len(other), np.int64)
        by_left[a], by_left[b] = mine[self.by_left], theirs[other.by_left]
        return Level(*(put(getattr(self, k), getattr(other, k)) for k in ("key", "right", "left", "lo", "hi", "ids")), by_left)

    def matches(self, length: int, flags: np.ndarray) -> None:
        """Marks flags[id, d] for every string, d bytes of it before the anchor, that occurs more than once.

        Anchors whose following length - d bytes agree are an interval of the one order, those whose
        preceding d bytes agree are an interval of the other: strings are equal if both are.
        """
        follow = _prefixes(self.right)
        before = _prefixes(self.left[self.by_left])
        for d in range(int(self.lo.min()), int(self.hi.max()) + 1):
            here = np.flatnonzero((self.lo <= d) & (self.hi >= d))
            if len(here) < 2:
                continue
            one = np.cumsum(follow < length - d)
            two = np.empty(len(self), np.int64)
            two[self.by_left] = np.cumsum(before < d)
            both = one[here] * len(self) + two[here]
            by = np.argsort(both, kind="stable")
            same = both[by][1:] == both[by][:-1]
            flags[self.ids[here[by[1:][same]]], d] = True
            flags[self.ids[here[by[:-1][same]]], d] = True


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the items of two ordered arrays go in their merge."""
    theirs = np.searchsorted(a, b, "right") + np.arange(len(b))
    free = np.ones(len(a) + len(b), bool)
    free[theirs] = False
    return np.flatnonzero(free), theirs


def _prefixes(ordered: np.ndarray) -> np.ndarray:
    """Common prefix of each item with the one before (-1 for the first)."""
    n, width = len(ordered), ordered.dtype.itemsize
    out = np.full(n, -1, np.int64)
    b = ordered.view(np.uint8).reshape(n, width)
    for at in range(1, n, 16_384):
        end = min(n, at + 16_384)
        differ = b[at:end] != b[at - 1:end - 1]
        out[at:end] = np.where(differ.any(1), differ.argmax(1), width)
    return out


class Family:
    """Suffix arrays of geometric sizes: a new batch is scanned against all, equals merge."""

    def __init__(self, length: int):
        self.length, self.levels = length, []
        self.flags = np.zeros((0, length - GRAM + 1), bool)

    def __len__(self) -> int:
        return len(self.flags)

    def add(self, key: np.ndarray, contexts: list[bytes], lo: np.ndarray, hi: np.ndarray) -> None:
        ids = np.arange(len(key)) + len(self.flags)
        self.flags = np.concatenate((self.flags, np.zeros((len(key), self.flags.shape[1]), bool)))
        new = Level.build(key, contexts, lo, hi, ids, self.length)
        new.matches(self.length, self.flags)
        for level in self.levels:
            shared = np.isin(level.key, new.key)
            if shared.any():
                level.part(shared).merge(new.part(np.isin(new.key, level.key))).matches(self.length, self.flags)
        while self.levels and len(self.levels[-1]) <= len(new):
            new = self.levels.pop().merge(new)
        self.levels.append(new)


def _runs(flags: np.ndarray) -> list[list[dict]]:
    """For each row the runs of true places as (a, b), both inside."""
    n, width = flags.shape
    edge = np.zeros((n, width + 2), np.int8)
    edge[:, 1:-1] = flags
    step = np.diff(edge, axis=1)
    r, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    out: list[list[dict]] = [[] for _ in range(n)]
    for i, x, y in zip(r.tolist(), a.tolist(), (b - 1).tolist(), strict=True):
        out[i].append({"a": x, "b": y})
    return out


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                   crowd: int = CROWD) -> DataFrame:
    """(id0, th, span): spans (s, e) of starts of length-byte strings that also start elsewhere, one a row; s = -1
    if the text has an exact copy. th is a hash of the text, id0 its id or 0; a span may come more than once.

    Exact copies are counted apart and one of each stands for all. Of the others only anchors whose
    gram occurs more than once go on, with the bytes around them; equal contexts are folded into one
    before they travel, and what is folded is repeated throughout. Only keys with several contexts,
    one of them single, meet in a family of suffix arrays. A key with more than crowd contexts is
    dealt out by the hashes of its strings, counted with map-side combine.
    """
    text = octets(text_col)
    read = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id0"), text.alias("t"),
                       F.xxhash64(text).alias("th"))
    copies = (docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id0"), F.xxhash64(text).alias("th"),
                          F.xxhash64(text, F.lit(1)).alias("tg"), F.octet_length(text).alias("n_bytes"))
              .where(F.col("n_bytes") >= length))
    groups = copies.groupBy("th", "tg").agg(F.count(F.lit(1)).alias("n"), F.min("id0").alias("least"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            for part in slices(batch, 1):
                found = [anchors(t, length) for t in part.column(1).to_pylist()]
                row = np.repeat(np.arange(part.num_rows), [len(f[0]) for f in found])
                key, at, lo, hi = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
                ids, th = part.column(0).to_numpy()[row], part.column(2).to_numpy()[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(ids), pa.array(th), *(pa.array(x.astype(np.int32)) for x in (at, lo, hi))],
                    names=["key", "id0", "th", "at", "lo", "hi"])

    chosen = read.where(F.octet_length("t") >= length).mapInArrow(
        choose, "key long, id0 long, th long, at int, lo int, hi int")
    # counts by key are read from tables, so that Spark can split a hot key in the joins on it
    often = stored(chosen.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    wanted = (chosen.join(often, "key").groupBy("id0", "th")
              .agg(F.collect_set(F.struct("at", "lo", "hi", "key")).alias("places")))
    stand = groups.select(F.col("least").alias("id0"), "th").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            for part in slices(batch, 2, 1 << 21):
                rows = [(i, th, p["at"], p["lo"], p["hi"], p["key"], t[p["at"] - p["hi"]:p["at"] - p["lo"] + length])
                        for i, th, t, places in zip(*(c.to_pylist() for c in part.columns), strict=True)
                        for p in sorted(places, key=lambda p: p["at"])]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                     names=["id0", "th", "at", "lo", "hi", "key", "context"])

    around = stored(read.join(wanted, ["id0", "th"]).join(stand, ["id0", "th"], "left_semi")
                    .select("id0", "th", "t", "places")
                    .mapInArrow(cut, "id0 long, th long, at int, lo int, hi int, key long, context binary"))
    name = [F.xxhash64("context", "lo", "hi").alias("c1"), F.xxhash64("hi", "lo", "context").alias("c2")]
    folded = around.groupBy("key", "lo", "hi", "context").agg(F.count(F.lit(1)).alias("n"))
    by_key = stored(folded.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
                    .where("m > 1 and least = 1"))
    twice = folded.where("n > 1").select(*name, F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b"))).alias("runs"))
    open_ = folded.join(by_key, "key").select("key", "lo", "hi", "context", "n", "m")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, names, single, last = Family(length), [], [], None

        def give() -> pa.RecordBatch:
            keep = np.flatnonzero(np.array(single, bool) & family.flags.any(1)) if len(family) else np.zeros(0, int)
            return pa.RecordBatch.from_arrays(
                [pa.array([names[i][0] for i in keep], pa.int64()), pa.array([names[i][1] for i in keep], pa.int64()),
                 pa.array(_runs(family.flags[keep]), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                names=["c1", "c2", "runs"])

        for batch in let_go(batches):
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                key = part.column(0).to_numpy()
                cut_at = 0
                if len(family) > FAMILY:
                    # a new family begins where a new key does
                    cut_at = len(key) if (key == last).all() else int(np.argmax(key != last))
                for a, b in ((0, cut_at), (cut_at, len(key))):
                    if a == cut_at and cut_at < len(key) and len(family) > FAMILY:
                        yield give()
                        family, names, single = Family(length), [], []
                    if b > a:
                        p = part.slice(a, b - a)
                        family.add(p.column(0).to_numpy(), p.column(3).to_pylist(), p.column(1).to_numpy().astype(np.int64),
                                   p.column(2).to_numpy().astype(np.int64))
                        names += list(zip(p.column(4).to_pylist(), p.column(5).to_pylist(), strict=True))
                        single += [n == 1 for n in p.column(6).to_pylist()]
                last = key[-1]
        yield give()

    runs = "c1 long, c2 long, runs array<struct<a int, b int>>"
    sorted_ = (open_.where(F.col("m") <= crowd).select("key", "lo", "hi", "context", *name, "n")
               .repartition("key").sortWithinPartitions("key"))
    scanned = sorted_.mapInArrow(scan, runs)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            for start in range(0, batch.num_rows, 256):
                rows = []
                for lo, hi, context, c1, c2 in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    rows += [(xxhash.xxh3_128_digest(context[hi - d:hi - d + length]), c1, c2, d) for d in range(lo, hi + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)],
                    names=["s", "c1", "c2", "d"])

    strings = (open_.where(F.col("m") > crowd).select("lo", "hi", "context", *name)
               .mapInArrow(spell, "s binary, c1 long, c2 long, d int"))
    often_said = strings.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    dealt = strings.join(often_said, "s").select("c1", "c2", F.array(F.struct(F.col("d").alias("a"), F.col("d").alias("b"))).alias("runs"))
    told = stored(twice.unionByName(scanned).unionByName(dealt))
    found = around.select("id0", "th", "at", *name).join(told, ["c1", "c2"])
    spans = found.select("id0", "th", F.explode(F.transform("runs", lambda r: F.struct(
        (F.col("at") - r["b"]).alias("s"), (F.col("at") - r["a"]).alias("e")))).alias("span"))
    whole = (copies.join(groups.where("n > 1"), ["th", "tg"])
             .select("id0", "th", F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e")).alias("span")))
    return spans.unionByName(whole)


def repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
            crowd: int = CROWD) -> DataFrame:
    """(id0, th, spans): the repeated_spans of each text that has some."""
    return (repeated_spans(docs, length, id_col, text_col, crowd)
            .groupBy("id0", "th").agg(F.collect_set("span").alias("spans")))


def gone(n: int, spans: list[dict] | None, length: int) -> np.ndarray:
    """Which of n bytes the strings that start in the spans cover."""
    if not spans:
        return np.zeros(n, bool)
    s = np.array([x["s"] for x in spans], np.int64)
    e = np.array([x["e"] for x in spans], np.int64)
    if (s < 0).any():
        return np.ones(n, bool)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, s, 1)
    np.add.at(step, np.minimum(e + length, n), -1)
    return np.cumsum(step)[:n] > 0


def _removed(docs: DataFrame, columns: list[str], length: int, id_col: str, text_col: str, crowd: int) -> DataFrame:
    found = repeats(docs, length, id_col, text_col, crowd).withColumnsRenamed({"id0": "_id0", "th": "_th"})
    text = octets(text_col)
    return (docs.select(*(F.col(f"`{c}`") for c in columns), text.alias("_t"))
            .join(found, (F.coalesce(F.col(id_col).cast("long"), F.lit(0)) == F.col("_id0")) & (F.xxhash64("_t") == F.col("_th")), "left")
            .select(*(F.col(f"`{c}`") for c in columns), "_t", F.col("spans").alias("_spans")))


def measure_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                    crowd: int = CROWD) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    Every byte is removed that lies in a string of length bytes which also starts anywhere else, in
    the same or another document; overlaps count, and strings are judged on the texts as given.
    Null, empty and shorter texts lose nothing; a row given twice is its own copy and loses all if it
    is long enough; null ids are kept and judged like any other. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                out = gone(len(text), spans.as_py(), length)
                kept = np.frombuffer(text, np.uint8)[~out].tobytes() if out.any() else text
                starts = int(np.count_nonzero(np.diff(out.astype(np.int8), prepend=0) == 1))
                rows.append((len(text), int(out.sum()), starts, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                                             names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _removed(docs, [id_col], length, id_col, text_col, crowd).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                   crowd: int = CROWD) -> DataFrame:
    """docs, all rows and columns, with those bytes taken out of text_col (see measure_repeats).

    A character that loses some of its bytes goes as a whole; a null text stays null.
    """
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            for part in slices(batch, len(names)):
                texts = []
                for text, was, spans in zip(part.column(len(names)).to_pylist(), part.column(at), part.column(len(names) + 1).to_pylist(), strict=True):
                    out = gone(len(text), spans, length)
                    texts.append(None if not was.is_valid else np.frombuffer(text, np.uint8)[~out].tobytes().decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(part.columns[:len(names)])], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return _removed(docs, names, length, id_col, text_col, crowd).mapInArrow(run, schema)
