"""Harmonic packing: pieces of about capacity / j fill bins that take exactly j of them."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.bpe import text_of
from emberline.llm.common import octets, slices, stored
from emberline.llm.merges import load

COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_lengths(total: int, capacity: int, slack: int) -> list[int]:
    """Lengths of a document's pieces: whole bins, then reciprocal shares of a bin.

    A rest that leaves at most slack of a bin of its class free is one piece; from a longer-wasting
    rest the next smaller share, capacity // (j + 1), is cut off exactly.
    """
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        j = capacity // rest
        piece = rest if capacity - j * rest <= slack else capacity // (j + 1)
        out.append(piece)
        rest -= piece
    return out


class Bins:
    """Open bins by class; class j closes a bin at its j-th piece."""

    def __init__(self, capacity: int, prefix: int):
        self.capacity, self.next, self.open = capacity, prefix, defaultdict(list)

    def add(self, piece: tuple, length: int) -> list[tuple]:
        """The placed pieces of a bin if this one fills it, else nothing."""
        held = self.open[self.capacity // length]
        held.append((piece, length))
        if len(held) < self.capacity // length:
            return []
        del self.open[self.capacity // length]
        return self.place(held)

    def place(self, held: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for piece, length in held:
            out.append((*piece, self.next, at))
            at += length
        self.next += 1
        return out

    def rest(self) -> list[tuple]:
        return [x for held in self.open.values() for x in held]


def best_fit(pieces: list[tuple], capacity: int) -> list[list[tuple]]:
    """Pieces of unfilled bins together, longest first, each where it leaves least room."""
    rooms: dict[int, list[list[tuple]]] = defaultdict(list)
    filled = []
    for piece, length in sorted(pieces, key=lambda x: -x[1]):
        room = min((r for r, bins in rooms.items() if bins and r >= length), default=capacity)
        held = rooms[room].pop() if rooms[room] else []
        held.append((piece, length))
        if room == length:
            filled.append(held)
        else:
            rooms[room - length].append(held)
    return filled + [x for bins in rooms.values() for x in bins]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
         end_id: int = 1, slack: int = 24, fan_in: int = 16) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece and its place.

    A document is its ids and end_id; a null or empty text is end_id alone. Every task cuts its
    documents and fills the bins of each class by itself. What bins lack their count at the end goes
    to fewer tasks, fan_in to one, which fill on; a task hands on at most j - 1 pieces of class j,
    so the last one is as small at any size, and it ends the rest by best fit. Repeated rows are
    packed as often as given.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {COLUMNS}"
    names = [id_col, *(c.split()[0] for c in COLUMNS.split(", "))]

    def table(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, bins, id_type = load(path), Bins(capacity, TaskContext.get().partitionId() << 36), None
        for batch in batches:
            id_type = batch.column(0).type
            for part in slices(batch, 1, 1 << 22):
                rows = []
                coded = bpe.encode_all([text_of(t) for t in part.column(1).to_pylist()])
                for doc, ids in zip(part.column(0).to_pylist(), coded, strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    at = 0
                    for n in cut_lengths(len(ids), capacity, slack):
                        crc = zlib.crc32(ids[at:at + n].tobytes())
                        rows += bins.add((doc, at, n, crc, len(ids)), n)
                        at += n
                yield table(rows, id_type)
        if bins.open:
            yield table([(*piece, None, None) for piece, _ in bins.rest()], id_type)

    def again(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins, id_type = Bins(capacity, level << 56 | TaskContext.get().partitionId() << 36), None
            for batch in batches:
                id_type, rows = batch.column(0).type, []
                for piece in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                    rows += bins.add(piece, piece[2])
                yield table(rows, id_type)
            if bins.open and last:
                yield table([row for held in best_fit(bins.rest(), capacity) for row in bins.place(held)], id_type)
            elif bins.open:
                yield table([(*piece, None, None) for piece, _ in bins.rest()], id_type)
        return run

    read = docs.select(id_col, octets(text_col).alias("t"))
    placed = stored(read.mapInArrow(first, schema))
    tasks, level, done = read.rdd.getNumPartitions(), 1, []
    while True:
        done.append(placed.where("sequence_id is not null"))
        open_ = placed.where("sequence_id is null")
        tasks = -(-tasks // fan_in)
        dealt = open_.coalesce(1) if tasks == 1 else open_.repartition(tasks, F.xxhash64(id_col, "start"))
        placed = stored(dealt.mapInArrow(again(level, tasks == 1), schema))
        level += 1
        if tasks == 1:
            break
    for part in done:
        placed = placed.unionByName(part)
    return placed
