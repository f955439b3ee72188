"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Found and validated: e-mail addresses, telephone numbers, IPv4 addresses (octets to 255), payment cards
(13-19 digits, Luhn), IBANs (mod 97), US social security numbers (issuable ranges), calendar dates, and
quoted or hexadecimal secrets of 32 and more hex digits. A value's variable part is read as one number
below N, permuted in 0..N-1 by a keyed Feistel network over two halves (cycle-walked into the range),
and written back in the same format: same length, letter case, separators; check digits are computed
anew, so pseudonyms validate as their values did. The key and the kind of value fix the permutation:
equal values get equal pseudonyms in every document and format (a card with or without spaces is one
number, but month-first dates), different values different ones; only the holder of the key can go back (``reveal``).

A date of two-digit parts is day first, or month first where only that can be meant; the latter are
permuted among themselves, so their order of parts stays plain. Four numbers after "version" or "release"
are no address. Domains of e-mail addresses are permuted but for their last label. A number that fails its validation
is left alone. Results on odd input: null text stays null, empty stays empty; repeated rows are each
rewritten alike; extra columns are kept; an empty table gives an empty result; texts are scanned whole.
"""

from __future__ import annotations

import calendar
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "phone", "ip", "card", "iban", "ssn", "date", "secret")


class Feistel:
    """A keyed permutation of 0..n-1: halves modulo a and b with a * b >= n, walked until inside."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.a = max(1, isqrt(max(0, n - 1)) + 1)
        self.b = -(-n // self.a)
        self.bytes = (max(self.a, self.b).bit_length() + 7) // 8 + 8
        self.key = hmac.digest(key, f"{tweak}/{n}".encode(), "sha256")

    def _f(self, i: int, half: int, modulus: int) -> int:
        out, block = b"", 0
        data = half.to_bytes(self.bytes, "big")
        while len(out) < self.bytes:
            out += hashlib.blake2b(bytes([i, block]) + data, key=self.key, digest_size=32).digest()
            block += 1
        return int.from_bytes(out[: self.bytes], "big") % modulus

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)  # left below a, right below b
        for i in range(0, ROUNDS, 2):
            left = (left + self._f(i, right, self.a)) % self.a
            right = (right + self._f(i + 1, left, self.b)) % self.b
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS - 2, -1, -2):
            right = (right - self._f(i + 1, left, self.b)) % self.b
            left = (left - self._f(i, right, self.a)) % self.a
        return left * self.b + right

    def forward(self, x: int) -> int:
        y = self._once(x)
        while y >= self.n:
            y = self._once(y)
        return y

    def backward(self, y: int) -> int:
        x = self._back(y)
        while x >= self.n:
            x = self._back(x)
        return x


# Values as one number: characters of the classes digit, lower, upper and hex, the rest standing still.
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _classes(text: str, hexa: bool) -> list[str]:
    if hexa:
        upper = any("A" <= c <= "F" for c in text)
        return ["0123456789ABCDEF" if upper else "0123456789abcdef"] * len(text)
    return [next((k for k in _CLASSES if c in k), "") for c in text]


def _swap(text: str, kind: str, key: bytes, ahead: bool, hexa: bool = False) -> str:
    """Permutes all letters and digits of a text within their classes, as one mixed-radix number."""
    alphabets = _classes(text, hexa)
    x, n = 0, 1
    for c, k in zip(text, alphabets, strict=True):
        if k:
            x, n = x * len(k) + k.index(c), n * len(k)
    shape = "".join({0: "-", 10: "d", 16: "x", 26: "l"}[len(k)] if not k or k[0] != "A" else "u" for k in alphabets)
    perm = Feistel(key, f"{kind}/{shape}", n)
    y = perm.forward(x) if ahead else perm.backward(x)
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if k := alphabets[i]:
            y, digit = divmod(y, len(k))
            out[i] = k[digit]
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _relaid(digits: str, like: str) -> str:
    """Digits (or letters) in the places of those of another text."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in like)


def _card(value: str, key: bytes, ahead: bool) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or not digits.strip("0"):
        return None
    body = _swap(digits[:-1], "card", key, ahead)
    while not (whole := body + next(d for d in "0123456789" if luhn(body + d))).strip("0"):
        body = _swap(body, "card", key, ahead)
    return _relaid(whole, value)


def _email(value: str, key: bytes, ahead: bool) -> str:
    head, _, last = value.rpartition(".")
    return f"{_swap(head, 'email', key, ahead)}.{last}"


def _phone(value: str, key: bytes, ahead: bool) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 8 <= len(digits) <= 15:
        return None
    code = digits[:-10] if len(digits) > 10 else re.match(r"\d{0,3}", value[1:])[0] if value[0] == "+" else ""
    return _relaid(code + _swap(digits[len(code) :], "phone", key, ahead), value)


def _ip(value: str, key: bytes, ahead: bool) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    perm = Feistel(key, "ip", 1 << 32)
    x = int.from_bytes(bytes(map(int, parts)), "big")
    y = perm.forward(x) if ahead else perm.backward(x)
    return ".".join(map(str, y.to_bytes(4, "big")))


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _iban(value: str, key: bytes, ahead: bool) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    country, body = plain[:2], _swap(plain[4:], "iban" + plain[:2], key, ahead)
    check = 98 - _iban_number(body + country + "00") % 97
    return _relaid(f"{country}{check:02d}{body}", value)


def _ssn(value: str, key: bytes, ahead: bool) -> str | None:
    a, b, c = map(int, value.split("-"))
    if a in (0, 666) or a > 899 or not b or not c:
        return None
    areas = 898  # 1..899 without 666
    x = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
    perm = Feistel(key, "ssn", areas * 99 * 9999)
    y = perm.forward(x) if ahead else perm.backward(x)
    y, c = divmod(y, 9999)
    a, b = divmod(y, 99)
    return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"


_FIRST_YEAR, _LAST_YEAR = 1900, 2099


@lru_cache(1)
def _day_one() -> int:
    from datetime import date

    return date(_FIRST_YEAR, 1, 1).toordinal()


def _date(value: str, key: bytes, ahead: bool) -> str | None:
    from datetime import date

    parts = re.split(r"[-/.]", value)
    at = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0)  # year first, or day first
    if at[0] and int(parts[1]) > 12:
        at = (2, 0, 1)  # only month first can be meant
    y, m, d = (int(parts[i]) for i in at)
    if not (_FIRST_YEAR <= y <= _LAST_YEAR and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    perm = Feistel(key, "date", date(_LAST_YEAR, 12, 31).toordinal() - _day_one() + 1)
    turn = perm.forward if ahead else perm.backward
    new = date.fromordinal(_day_one() + turn(date(y, m, d).toordinal() - _day_one()))
    while at == (2, 0, 1) and new.day <= 12:  # walked on to a day that shows the order of the parts
        new = date.fromordinal(_day_one() + turn(new.toordinal() - _day_one()))
    text = (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")
    out = [""] * 3
    for i, t in zip(at, text, strict=True):
        out[i] = t
    marks = re.findall(r"[-/.]", value)
    return out[0] + marks[0] + out[1] + marks[1] + out[2]


_TURN: dict[str, Callable[[str, bytes, bool], str | None]] = {
    "email": _email,
    "phone": _phone,
    "ip": _ip,
    "card": _card,
    "iban": _iban,
    "ssn": _ssn,
    "date": _date,
    "secret": lambda v, key, ahead: _swap(v, "secret", key, ahead, True) if not (re.search("[a-f]", v) and re.search("[A-F]", v)) else _swap(v, "secret", key, ahead),
}
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_HEX = re.compile(r"(?<![A-Za-z0-9])(?=[A-Fa-f0-9]*[A-Fa-f])(?=[A-Fa-f0-9]*[0-9])[A-Fa-f0-9]{32,}(?![A-Za-z0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
#: Starts at a digit (or + or bracket): tried in this order at each place.
_NUMBER = re.compile(
    r"(?<![A-Za-z0-9@+])(?:"
    r"(?P<ip>(?<![.\d])(?<!ersion )(?<!elease )\d{1,3}(?:\.\d{1,3}){3}(?![.]?\d))"
    r"|(?P<date>(?:(?:19|20)\d\d(?P<m1>[-/.])\d\d(?P=m1)\d\d|\d\d(?P<m2>[-/.])\d\d(?P=m2)(?:19|20)\d\d)(?![-/.]?\d))"
    r"|(?P<ssn>\d{3}-\d\d-\d{4}(?![-]?\d))"
    r"|(?P<card>\d{13,19}(?!\d)|\d{4}(?:(?P<m3>[ -])\d{4})(?:(?P=m3)\d{4}){2}(?!\d)|\d{4}(?P<m4>[ -])\d{6}(?P=m4)\d{5}(?!\d))"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+\d{10,14}(?!\d)|\+\d{1,3}(?:[ .-](?:\(\d{1,5}\)|\d{2,5})){2,5}(?!\d))"
    r")(?![A-Za-z])"
)


class Pseudonymiser:
    """Rewrites texts; ``ahead`` False goes back."""

    MEMO = 100_000

    def __init__(self, key: bytes, ahead: bool = True):
        self.key, self.ahead = key, ahead
        self.memo: dict[tuple[str, str], str | None] = {}

    def value(self, kind: str, value: str) -> str | None:
        got = self.memo.get((kind, value), "")
        if got == "":
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            got = self.memo[kind, value] = _TURN[kind](value, self.key, self.ahead)
        return got

    def text(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """(the text rewritten, how many values of each kind)."""
        found = dict.fromkeys(KINDS, 0)
        if not text:
            return text, found
        spans: list[tuple[int, int, str]] = []

        def take(start: int, kind: str, value: str) -> bool:
            new = self.value(kind, value)
            if new is not None:
                spans.append((start, start + len(value), new))
                found[kind] += 1
            return new is not None

        if "@" in text:
            for m in _EMAIL.finditer(text):
                take(m.start(), "email", m[0])
        for m in _HEX.finditer(text):
            take(m.start(), "secret", m[0])
        for m in _IBAN.finditer(text):
            take(m.start(), "iban", m[0])
        held = sorted(spans)
        for m in _NUMBER.finditer(text):
            kind = m.lastgroup
            if _over(held, m.start(), m.end()):
                continue
            take(m.start(), kind, m[0])
        if not spans:
            return text, found
        out, at = [], 0
        for a, b, new in sorted(spans):
            if a >= at:
                out += (text[at:a], new)
                at = b
        out.append(text[at:])
        return "".join(out), found


def _over(spans: list[tuple[int, int, str]], a: int, b: int) -> bool:
    from bisect import bisect_left

    i = bisect_left(spans, (b,))
    return i > 0 and spans[i - 1][1] > a


def _rewrite(key: bytes, ahead: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymiser(key, ahead)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                done = [p.text(t) for t in part.column("text").to_pylist()]
                rest = [c for c in part.schema.names if c != "text"]
                counts = [pa.array([d[1][k] for d in done], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *counts, pa.array([d[0] for d in done], pa.string())], [*rest, *(f"n_{k}" for k in KINDS), "pii_text"])

    return run


def pseudonymise(docs: DataFrame, key: bytes, ahead: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) -> its columns with text rewritten, and n_email, n_phone, ... (columns of
    these names that the table has itself are replaced)."""
    counts = [f"n_{k}" for k in KINDS]
    rest = [c for c in docs.columns if c != "text" and c not in counts and c != "pii_text"]
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), *(f"{c} long" for c in counts), "pii_text string"])
    done = docs.select(*rest, F.col("text").cast("string").alias("text")).mapInArrow(_rewrite(key, ahead), fields)
    order = [c for c in docs.columns if c in rest or c == "text"]
    return done.select(*(F.col("pii_text").alias("text") if c == "text" else F.col(f"`{c}`") for c in order), *counts)


def op4_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """The key of this query is an example; a deployment passes its own secret."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), b"example key of the query")
