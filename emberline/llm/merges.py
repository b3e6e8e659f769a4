"""Byte-level BPE ids of many texts at once: each different piece of a batch is merged once, rows of one length together."""

from __future__ import annotations

import heapq
import json
from itertools import chain

import numpy as np
import regex

from emberline.llm.bpe import ALL_LETTERS, PIECES, byte_letters
from emberline.llm.common import kept

#: Bytes of a piece beyond which it is merged by itself.
LONG = 48
NEVER = np.int32(np.iinfo(np.int32).max)


class _Numbers(dict):
    """Numbers for things in the order they are first asked for."""

    def __missing__(self, thing: str) -> int:
        n = self[thing] = len(self)
        return n


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of stretches (start, size), one stretch after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class Merges:
    """The merges of a vocabulary as sorted pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters, vocab = byte_letters(), said["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        self.by_byte = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.by_byte[byte] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        left, right, whole = (np.array(c, np.int64) for c in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        key = left << 32 | right
        by = np.argsort(key)
        self.keys, self.ranks, self.whole = key[by], by.astype(np.int32), whole.astype(np.int32)
        self.of_pair = {(a, b): r for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        self.pattern = regex.compile(PIECES)
        self.loose = regex.compile(r" (?!\S)")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge_rows(self, row: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(numbers of rows, their ids) by width: in every row the first pair of least rank merges, until none does."""
        out, number = [], np.arange(len(row))
        rank = self.rank(row[:, :-1], row[:, 1:])
        while len(row):
            at = rank.argmin(1) if row.shape[1] > 1 else np.zeros(len(row), np.int64)
            least = rank[np.arange(len(row)), at] if row.shape[1] > 1 else np.full(len(row), NEVER)
            done = least == NEVER
            if done.any():
                out.append((number[done], row[done]))
                go = ~done
                row, rank, number, at, least = row[go], rank[go], number[go], at[go], least[go]
                if not len(row):
                    break
            n, width = row.shape
            every = np.arange(n)
            row[every, at] = self.whole[least]
            stay = np.ones((n, width), bool)
            stay[every, at + 1] = False
            row = row[stay].reshape(n, width - 1)
            # the ranks of the two pairs that the new id is in are looked up again
            stay[every, at + 1] = True
            stay[every, at] = False
            rank = rank[stay[:, :-1]].reshape(n, width - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            rank[before, at[before] - 1] = self.rank(row[before, at[before] - 1], row[before, at[before]])
            rank[after, at[after]] = self.rank(row[after, at[after]], row[after, at[after] + 1])
        return out

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for one long piece, with its pairs in a heap."""
        n = len(ids)
        ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.of_pair.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = ahead[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.whole[r]), -1
            ahead[i] = ahead[j]
            if ahead[i] < n:
                behind[ahead[i]] = i
            for k in (behind[i], i):
                m = ahead[k] if k >= 0 else n
                if k >= 0 and m < n and (r := self.of_pair.get((ids[k], ids[m]))) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[m]))
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): the ids of all pieces and where each one's are."""
        raw = [p.encode() for p in pieces]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        start, size, flat, total = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64), [], 0
        by = np.argsort(length, kind="stable")
        cuts = [*np.flatnonzero(np.diff(length[by], prepend=-1)).tolist(), len(by)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            group, width = by[a:b], int(length[by[a]])
            if width > LONG:
                parts = [(np.array([k]), np.array([self.merge_long(self.by_byte[np.frombuffer(raw[k], np.uint8)].tolist())], np.int32))
                         for k in group.tolist()]
            else:
                rows = np.frombuffer(b"".join([raw[k] for k in group.tolist()]), np.uint8).reshape(len(group), width)
                parts = [(group[number], ids) for number, ids in self.merge_rows(self.by_byte[rows])]
            for number, ids in parts:
                size[number] = ids.shape[1]
                start[number] = total + np.arange(len(number)) * ids.shape[1]
                flat.append(ids.ravel())
                total += ids.size
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), start, size

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each whole text, special tokens in it taken as such.

        A text may be cut at any space with a letter or sign on at least one side, the space going
        with what follows: no piece reaches over such a place. So texts are looked up word by word;
        those with a space between white space are cut by the pattern.
        """
        words, pieces, sizes, sequence = _Numbers(), _Numbers(), [], []
        inside = [any(s in t for s in self.special) for t in texts]
        for text, odd in zip(texts, inside, strict=True):
            # a word after a space has its number, a piece by itself the complement of its own
            if odd:
                found = []
            elif any(m.start() and text[m.start() - 1].isspace() for m in self.loose.finditer(text)):
                found = [~pieces[p] for p in self.pattern.findall(text)]
            else:
                head, *rest = text.split(" ")
                found = [~pieces[p] for p in self.pattern.findall(head)]
                found += map(words.__getitem__, rest)
            sizes.append(len(found))
            sequence.append(found)
        cut = [[pieces[" " + w]] if ALL_LETTERS.issuperset(w) else [pieces[p] for p in self.pattern.findall(" " + w)] for w in words]
        several = np.fromiter(map(len, cut), np.int64, len(cut))
        # chunks: words first, then each piece as a chunk of its own
        chunk_size = np.concatenate([several, np.ones(len(pieces), np.int64)])
        chunk_start = np.cumsum(chunk_size) - chunk_size
        chunk_piece = np.concatenate([np.fromiter(chain.from_iterable(cut), np.int64, int(several.sum())), np.arange(len(pieces))])
        ids, start, size = self.encode_pieces(list(pieces))
        chunk = np.fromiter(chain.from_iterable(sequence), np.int64, sum(sizes))
        chunk = np.where(chunk < 0, len(cut) + ~chunk, chunk)
        piece = chunk_piece[spread(chunk_start[chunk], chunk_size[chunk])]
        tokens = ids[spread(start[piece], size[piece])].astype("<u4")
        piece_ends = np.concatenate([[0], np.cumsum(chunk_size[chunk])])[np.cumsum(sizes)] if sizes else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(size[piece])])[piece_ends]
        out = np.split(tokens, ends[:-1]) if len(ends) else []
        for k in np.flatnonzero(inside).tolist():
            parts = self.cut.split(texts[k])
            plain = iter(self.encode_all([p for p in parts if p not in self.special]))
            out[k] = np.concatenate([np.array([self.special[p]], "<u4") if p in self.special else next(plain) for p in parts])
        return out


def load(path: str) -> Merges:
    """One per worker and file, as long as the worker runs no other operator."""
    return kept(("merges", path), lambda: Merges(path))
