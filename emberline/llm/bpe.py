"""Byte-level BPE: backtracking encoder over longest matches, decoder over an offset table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from emberline.llm.common import kept, octets, slices

#: Fixed value: how the public tokenizer cuts a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces, words and pairs that a worker keeps.
KEPT_PIECES = 500_000
KEPT_PAIRS = 400_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Letters that every version of the character tables knows.
ALL_LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha())


class Bpe:
    """A vocabulary with its match automaton, merge pairs and offset table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters, vocab = byte_letters(), said["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for text, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in text)
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.whole = {self.tokens[i]: i for i in vocab.values()}
        self.halves = {i: (i, i) for i in vocab.values()}
        self.joined = {}
        for left, right in merges:
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.joined[a, b] = c
            self.halves[c] = a, b
        self.shorter = {i: next((self.whole[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.whole), None)
                        for t, i in self.whole.items()}
        self.by_letters = {t.decode("latin-1"): i for t, i in self.whole.items()}
        self.matcher = ahocorasick.Automaton()
        for letters, i in self.by_letters.items():
            self.matcher.add_word(letters, i)
        self.matcher.make_automaton()
        self.widths = [len(t) for t in self.tokens]
        self.widest = max(self.widths)
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pattern = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.decimal = [str(i).encode() for i in range(size)]
        self.loose = regex.compile(r" (?!\S)")
        self.known = _Kept(self.pack_piece)
        self.words = _Kept(self.pack_word)
        self.break_ = self.known["\n"]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together would leave exactly a, b.

        Both are undone merge by merge, latest first; a pair met across the seam must not have
        merged before the merges that already hold its two sides.
        """
        found = self.compatible.get((a, b))
        if found is None:
            if len(self.compatible) > KEPT_PAIRS:
                self.compatible.clear()
            found = self.compatible[a, b] = self._fits(a, b)
        return found

    def _fits(self, a: int, b: int) -> bool:
        before = len(self.tokens)
        while True:
            if self.joined.get((a, b), before) < before:
                return False
            left_turn = a > b
            for _ in range(2):
                if left_turn:
                    before, inner = a, self.halves[a][1]
                    if inner != a:
                        a = inner
                        break
                else:
                    before, inner = b + 1, self.halves[b][0]
                    if inner != b:
                        b = inner
                        break
                left_turn = not left_turn
            else:
                return True

    def longest(self, letters: str, at: int) -> int:
        """The longest token at a place: as far as the automaton follows, back to a token's end."""
        ahead = letters[at:at + self.widest]
        n = self.matcher.longest_prefix(ahead)
        while n > 1:
            token = self.by_letters.get(ahead[:n])
            if token is not None:
                return token
            n -= 1
        return self.by_letters[ahead[:1]]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece: the longest token at each place, stepping back where a pair does not fit."""
        letters = piece if piece.isascii() else piece.encode().decode("latin-1")
        token = self.by_letters.get(letters)
        if token is not None:
            return [token]
        n = len(letters)
        width, compatible = self.widths, self.compatible
        dead: set[int] = set()
        ids: list[int] = []
        at, token = 0, self.longest(letters, 0)
        while True:
            last = ids[-1] if ids else None
            while token is not None:
                end = at + width[token]
                if end not in dead and (last is None or (
                        compatible[last, token] if (last, token) in compatible else self.fits(last, token))):
                    break
                token = self.shorter[token]
            if token is None:
                dead.add(at)
                token = ids.pop()
                at -= width[token]
                token = self.shorter[token]
                continue
            ids.append(token)
            at = end
            if at == n:
                return ids
            token = self.longest(letters, at)

    def pack_piece(self, piece: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.encode_piece(piece)))

    def pack_word(self, word: str) -> bytes:
        """Ids of a word without white space inside, or with it, and the space before it."""
        if "\n" in word:
            first, *rest = word.split("\n")
            # a single line break is a piece of its own, and letters after it are one
            if first and not first[-1].isspace() and all(map(str.isalpha, rest)) and ALL_LETTERS.issuperset("".join(rest)):
                return self.break_.join([self.words[first], *map(self.known.__getitem__, rest)])
        return self._pack_by_pattern(word)

    def _pack_by_pattern(self, word: str) -> bytes:
        pieces = self.pattern.findall(" " + word)
        if len(pieces) == 1:
            return self.pack_piece(pieces[0])
        return b"".join([self.words[p[1:]] if p[0] == " " and len(p) > 1 and p[1] not in " \n" else self.known[p]
                         for p in pieces])

    def pieces(self, text: str) -> bytes:
        """Ids of a text without special tokens, packed.

        A text may be cut at any space that has a letter or sign on at least one side, the space
        going with what follows it: no piece reaches over such a place. So most of a text is looked
        up word by word; texts with a space between white space are cut by the pattern.
        """
        for m in self.loose.finditer(text):
            if m.start() and text[m.start() - 1].isspace():
                return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))
        head, *words = text.split(" ")
        return b"".join([*map(self.known.__getitem__, self.pattern.findall(head)),
                         *map(self.words.__getitem__, words)])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text (uint32), special tokens in it taken as such."""
        if self.cut is None or not any(s in text for s in self.special):
            return np.frombuffer(self.pieces(text), "<u4")
        return np.frombuffer(b"".join(
            self.packed[self.special[part]] if part in self.special else self.pieces(part)
            for part in self.cut.split(text)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the decoded text; bytes that are not UTF-8 become replacement characters."""
        out = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at:at + (1 << 18)].astype(np.int64)
            length = self.lengths[part]
            ends = np.cumsum(length)
            place = np.repeat(self.starts[part] - (ends - length), length) + np.arange(ends[-1])
            out.append(self.blob[place].tobytes())
        return b"".join(out).decode("utf-8", "replace").encode()

    def digest(self, ids: np.ndarray) -> str:
        """Hash of the decimal ids joined by commas."""
        return hashlib.sha256(b",".join(map(self.decimal.__getitem__, ids.tolist()))).hexdigest()


class _Kept(dict):
    """Packed ids of what was met before; when full it keeps what it has, and now and then starts afresh."""

    def __init__(self, find):
        super().__init__()
        self.find, self.missed = find, 0

    def __missing__(self, text: str) -> bytes:
        ids = self.find(text)
        if len(self) < KEPT_PIECES:
            if len(text) <= 32 and "\n" not in text:
                self[text] = ids
        else:
            self.missed += 1
            if self.missed > 20 * KEPT_PIECES:
                self.missed = 0
                self.clear()
        return ids


def load(path: str) -> Bpe:
    """One per worker and file, as long as the worker runs no other operator."""
    return kept(("bpe", path), lambda: Bpe(path))


def text_of(value: bytes) -> str:
    return value.decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) for every row of docs: token ids and the text they decode to.

    path: a byte-level BPE file that every executor can read. A null or empty text has no ids and
    decodes to the empty text. Repeated rows come back as often as given.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [bpe.encode(text_of(t)) for t in part.column(1).to_pylist()]
                texts = [bpe.decode(x).decode() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                     pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, octets(text_col).alias("t")).mapInArrow(
        run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_decode as digests: (id_col, n_tokens, ids_sha256, decoded_sha256), nothing large leaves the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            counts, first, second = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(text_of(t.as_py()))
                counts.append(len(ids))
                first.append(bpe.digest(ids))
                second.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()),
                                              pa.array(second, pa.string())],
                                             names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, octets(text_col).alias("t")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
