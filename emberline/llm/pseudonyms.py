"""Format-preserving pseudonyms: private values are permuted within their own format by a keyed Feistel net."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import let_go, slices

ROUNDS = 8
DIGITS = "0123456789"
HEX = DIGITS + "abcdef"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Small letters beyond ASCII, by script: each is permuted within its own.
SCRIPTS = ["".join(c for c in map(chr, range(*ends)) if c.isalpha() and c.islower()) for ends in
           ((0xDF, 0x100), (0x101, 0x180), (0x3B1, 0x3CA), (0x430, 0x460))]
LETTER = "A-Za-z0-9\u00C0-\u017F\u0370-\u03FF\u0400-\u045F"
#: Most signs permuted as one number: half of their bits fit a hash of 64 bytes.
PIECE = 200
#: Dates are permuted among these days.
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: Feistel rounds on two halves, repeated until inside."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            said = hashlib.blake2b(right.to_bytes(width, "big"), key=key, digest_size=max(8, width),
                                   person=hashlib.blake2b(f"{tweak}/{size}/{r}".encode(), digest_size=16).digest())
            left, right = right, left ^ int.from_bytes(said.digest(), "big") & mask
        value = left << half | right
        if value < size:
            return value


def spell(text: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    """Permutes a text whose i-th sign lies in alphabets[i], among all such texts; long ones piece by piece."""
    if len(text) > PIECE:
        return "".join(spell(text[i:i + PIECE], alphabets[i:i + PIECE], key, f"{tweak}/{i}" if i else tweak) for i in range(0, len(text), PIECE))
    value, size = 0, 1
    for c, letters in zip(text, alphabets, strict=True):
        value = value * len(letters) + letters.index(c)
        size *= len(letters)
    value = permute(value, size, key, tweak)
    out = []
    for letters in reversed(alphabets):
        value, at = divmod(value, len(letters))
        out.append(letters[at])
    return "".join(reversed(out))


def classes(text: str) -> list[str]:
    """For each sign the letters of its kind; other signs stand for themselves."""
    if re.fullmatch(r"[0-9a-f]+", text) and re.search(r"\d", text):
        return [HEX] * len(text)
    return [next((k for k in (DIGITS, LOWER, UPPER, *SCRIPTS) if c in k), c) for c in text]


def refill(pattern: str, signs: str) -> str:
    """pattern with its letters and digits replaced, in order, by signs."""
    rest = iter(signs)
    return "".join(next(rest) if c.isascii() and c.isalnum() else c for c in pattern)


def luhn(digits: str) -> int:
    """The sum that is divisible by ten for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total


def _email(m: re.Match, key: bytes) -> str:
    name = "".join(c.lower() if len(c.lower()) == 1 else c for c in m[2])
    new = spell(name, classes(name), key, "email")
    return m[1] + "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for o, n in zip(m[2], new, strict=True)) + m[3]


def _card(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    body = spell(digits[:-1], [DIGITS] * (len(digits) - 1), key, "card")
    return refill(m[0], body + str(-luhn(body + "0") % 10))


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(m: re.Match, key: bytes) -> str | None:
    plain = m[0].replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = spell(plain[4:], classes(plain[4:].upper()) if not re.fullmatch(r"[0-9a-f]+", plain[4:]) else [DIGITS] * (len(plain) - 4),
                 key, "iban" + plain[:2])
    check = 98 - _iban_rest(plain[:2] + "00" + body)
    return refill(m[0], f"{plain[:2]}{check:02d}{body}")


def _address(m: re.Match, key: bytes) -> str | None:
    parts = [int(p) for p in m[0].split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in m[0].split(".")):
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _address6(m: re.Match, key: bytes) -> str | None:
    """Groups of zeros stay, so that an address keeps its form; the others are permuted together."""
    if not re.search(r"\d", m[0]) or not (m[0].count(":") > 2 or re.match(r"[23fF][0-9A-Fa-f]{3}:", m[0])):
        return None
    try:
        whole = IPv6Address(m[0])
    except AddressValueError:
        return None
    was = [int(g, 16) for g in whole.exploded.split(":")]
    value, size = 0, 1
    for g in filter(None, was):
        value, size = value * 0xFFFF + g - 1, size * 0xFFFF
    value = permute(value, size, key, "ip6" + "".join("01"[g > 0] for g in was))
    new = []
    for g in reversed(was):
        value, at = divmod(value, 0xFFFF) if g else (value, -1)
        new.append(at + 1)
    out = IPv6Address(sum(g << 16 * i for i, g in enumerate(new)))
    said = out.exploded if len(m[0]) == 39 else str(out)
    return said.upper() if m[0] == m[0].upper() else said


def _social(m: re.Match, key: bytes) -> str | None:
    def whole(n: int) -> bool:
        area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    value = int(m[0].replace("-", ""))
    if not whole(value):
        return None
    while True:
        value = permute(value, 10**9, key, "social")
        if whole(value):
            return refill(m[0], f"{value:09d}")


def _phone(m: re.Match, key: bytes) -> str | None:
    code = re.match(r"(?:\+\d{1,3})?", m[0])[0]
    digits = re.sub(r"\D", "", m[0][len(code):])
    if not 7 <= max(0, len(code) - 1) + len(digits) <= 15 or len(digits) < 6:
        return None
    return code + refill(m[0][len(code):], spell(digits, [DIGITS] * len(digits), key, "phone"))


def _named_phone(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[2])
    if not 7 <= len(digits) <= 15:
        return None
    return m[1] + refill(m[2], spell(digits, [DIGITS] * len(digits), key, "phone"))


def _day(m: re.Match, key: bytes) -> str | None:
    year_first = m["y1"] is not None
    sep = m["s1"] or m["s2"]
    a, b = (int(m["m1"]), int(m["d1"])) if year_first else (int(m["a"]), int(m["b"]))
    year = int(m["y1"] or m["y2"])
    month_first = year_first or (sep == "/" and b > 12)
    try:
        day = date(year, a, b) if month_first else date(year, b, a)
    except ValueError:
        return None
    at = (day - FIRST_DAY).days
    if not 0 <= at < DAYS:
        return None
    new = at
    while True:
        new = permute(new, DAYS, key, "date")
        found = FIRST_DAY + timedelta(new)
        # a day-first date must not turn into one that reads as month-first, and the other way round
        if year_first or sep != "/" or (month_first == (found.day > 12)):
            break
    if year_first:
        wide = 2 if len(m["m1"]) == len(m["d1"]) == 2 else 1
        return f"{found.year:04d}{sep}{found.month:0{wide}d}{sep}{found.day:0{wide}d}"
    first, second = (found.month, found.day) if month_first else (found.day, found.month)
    wide = 2 if len(m["a"]) == len(m["b"]) == 2 else 1
    return f"{first:0{wide}d}{sep}{second:0{wide}d}{sep}{found.year:04d}"


def _secret(m: re.Match, key: bytes) -> str:
    return m[1] + spell(m[2], classes(m[2]), key, "secret")


#: Name, pattern and pseudonym of each kind; where two begin at one place the earlier named is taken.
KINDS: list[tuple[str, str, Callable[[re.Match, bytes], str | None]]] = [
    ("email", rf"(?<![{LETTER}._%+-])([._%+-]*)([{LETTER}][{LETTER}._%+-]*)(@(?:[{LETTER}-]{{1,63}}\.)+[A-Za-z]{{2,24}})", _email),
    ("secret", r"""((?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?[ ]{0,3}[:=][ ]{0,3}["']?"""
               r"""|(?<![A-Za-z0-9])(?:(?i:bearer)[ ]{1,3}|AKIA|ASIA|AIza|sk-|gh[pousr]_|glpat-|xox[abprs]-)(?=[A-Za-z+/_.-]*\d))"""
               r"""([A-Za-z0-9+/_.-]{15,}[A-Za-z0-9+/_-])""", _secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("ip", r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)", _address),
    ("date", r"(?<![\d./-])(?:(?P<y1>\d{4})(?P<s1>[-/.])(?P<m1>\d{1,2})(?P=s1)(?P<d1>\d{1,2})"
             r"|(?P<a>\d{1,2})(?P<s2>[-/.])(?P<b>\d{1,2})(?P=s2)(?P<y2>\d{4}))(?!\d|[./-]\d)", _day),
    ("social", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)", _social),
    ("card", r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)", _card),
    ("phone", r"(?<![\w+])(?:(?:\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}"
              r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ -]?\d{2,4}){1,4})(?!\d|[.-]\d)", _phone),
    ("ip6", r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)", _address6),
    # a number without country code counts as a phone only after a word that says so
    ("named_phone", r"(\b(?i:phone|telephone|telefon|tel|mobile|cell|fax|whatsapp)[ .]{0,2}(?i:number|no\b|nr\b)?[ .:=]{0,4})"
                    r"(\d{2,5}[ /.-]?\d{3,8}(?:[ /.-]?\d{2,5}){0,2})(?!\d|[./-]\d)", _named_phone),
]
#: What ends a group of a value.
GAP = re.compile(r"[^A-Za-z0-9]")
COUNTS = [f"n_{name}" for name, *_ in KINDS]
#: Signs without which a kind cannot occur; texts without digit and @ need no look.
PLAIN = re.compile(r"[0-9@:=]")


def _values(text: str, pattern: re.Pattern, make: Callable[[re.Match, bytes], str | None], key: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of the values of a kind. What fails its check is tried without its last
    groups; then the search goes on at its second group, as a value may begin inside it."""
    at = 0
    while m := pattern.search(text, at):
        tried = m
        while tried and (new := make(tried, key)) is None:
            gaps = [g.start() for g in GAP.finditer(tried[0], 1)]
            tried = pattern.match(text, m.start(), m.start() + gaps[-1]) if gaps else None
        if tried:
            yield tried.start(), tried.end(), new
            at = tried.end()
        else:
            gap = GAP.search(m[0], 1)
            at = m.start() + gap.start() if gap else m.end()


class Pseudonyms:
    """Replaces private values in texts under one key."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.kinds = [(re.compile(pattern, re.ASCII), make) for _, pattern, make in KINDS]

    def __call__(self, text: str) -> tuple[str, list[int]]:
        """The text with pseudonyms, and how many values of each kind it held."""
        counts = [0] * len(self.kinds)
        if not PLAIN.search(text):
            return text, counts
        found = []
        for k, (pattern, make) in enumerate(self.kinds):
            found += [(start, k, end, new) for start, end, new in _values(text, pattern, make, self.key)]
        out, at = [], 0
        for start, k, end, new in sorted(found):
            if start < at:
                continue
            out += text[at:start], new
            at = end
            counts[k] += 1
        return "".join([*out, text[at:]]), counts


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with private values of text_col replaced, and a count of each kind (COUNTS).

    Emails (name part, capitals stay capitals), secrets of 16 or more signs given as token = "..", after bearer
    or with the prefix of a known kind of key, IBANs and card numbers with a right check digit (it is made
    right again), IPv4 and IPv6 addresses, calendar dates in digits with a year of four, US social numbers and phone
    numbers (country code kept; without one US numbers in three groups, and any after a word such as tel).
    Numbers that fail their check are left alone. One key turns one
    value into the same pseudonym in every document, whatever separators it is written with. A null
    text stays null, all other rows and columns are kept as they are, row by row, without a shuffle;
    an input column named like a count is replaced.
    """
    names = [c for c in docs.columns if c.lower() not in COUNTS]
    at = names.index(text_col)
    fields = [docs.schema[c] for c in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} long" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = Pseudonyms(key.encode())
        for batch in let_go(batches):
            for part in slices(batch, part_at):
                texts, counts = [], []
                for t in part.column(part_at).to_pylist():
                    text, n = (None, [0] * len(COUNTS)) if t is None else mask(t.decode("utf-8", "replace"))
                    texts.append(text)
                    counts.append(n)
                columns = [pa.array(texts, pa.string()) if i == part_at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array([n[k] for n in counts], pa.int64()) for k in range(len(COUNTS)))],
                    names=[*names, *COUNTS])

    part_at = at
    read = docs.select(*(F.col(f"`{c}`").cast("binary").alias(c) if c == text_col else F.col(f"`{c}`") for c in names))
    return read.mapInArrow(run, schema)
