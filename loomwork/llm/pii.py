"""Personal numbers and dates to format-preserving pseudonyms.

A keyed Feistel network permutes the values of each format, so a pseudonym has the
format of what it stands for, passes the same validation, and equal values stay equal
in every document. Without the key it can't be undone; with it, it can (`inverse`).

Formats and what validates them:

- iban: bare or in groups of four, by its check digits (mod 97). The digits behind these are permuted,
  letters stay, the check digits are set anew.
- card: 13 to 19 digits, bare, in groups of four, or 4-6-5, by the Luhn digit. The digits before it
  are permuted, and it is set anew.
- phone: +country and number, in groups parted by blanks, dots or hyphens or in one, 10 to 15 digits; ten digits with
  or without a 1 before them as (area) number or area-number, and bare or parted by blanks if area and exchange are such as
  North America assigns, all linked with the same number after +1; national numbers with a leading 0, bare, as five pairs, or as area and
  number. Country codes are read from the list below. What follows the code or the 0 is permuted among the numbers of its length that
  begin with 0 if and only if it does, and are North American if and only if it is; marks stay.
- ip: dotted IPv4 with four numbers up to 255; the 32 bits are permuted. IPv6 as the standard library
  reads it; its hexadecimal digits are permuted, colons stay.
- ssn: 3-2-4 digits with an area other than 000, 666 and 9xx, permuted among those valid.
- date: year-month-day (a time may follow), day.month.year, day/month/year, or month/day/year where only that can
  be meant, of 1900 to 2099 and existing. Days are permuted within these two centuries, among the dates
  whose day and month have as many digits.
- email: letters (Latin, Greek, Cyrillic) and digits of the local part, each kept in its kind; other signs and the domain stay.
- hex: 32 to 64 hexadecimal digits (keys, tokens), permuted as digits of base 16.

Equal values give equal pseudonyms in every spelling of marks; dates of different widths are different
values. What fails validation stays as it is. A null text gives a null text and no values; an
empty one likewise stays empty. Null ids and repeated rows are kept.
An empty table gives no rows; there are no ties, as the leftmost and then the first listed format is taken.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm.common import table
from loomwork.llm.text import slices

ROUNDS = 10
KINDS = ("iban", "card", "phone", "ip", "ssn", "date", "email", "hex")
FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"

PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])(?<![^\x00-\x7f])[A-Za-z0-9\u00c0-\uffff][\w.+\u00c0-\uffff-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<hex>(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![\w.-])[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\w-]))"
    r"|(?P<date>(?<![\w.-])(?:(?:19|20)\d\d-\d\d-\d\d(?=T\d\d:|(?![\w-]|\.\d))|(?:\d{1,2}\.\d{1,2}\.(?:19|20)\d\d|\d{1,2}/\d{1,2}/(?:19|20)\d\d)(?![\w-]|\.\d)))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)|(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9A-Fa-f]:)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w-]|\.\d))"
    r"|(?P<phone>(?<![\w.-])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,5}){2,4}(?![\w-]|\.\d)"
    r"|(?<![\w.-])(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-]|\.\d)|(?<![\w.-])(?:1 )?[2-9]\d\d ?[2-9]\d\d ?\d{4}(?![\w-]|\.\d| ?\d)"
    r"|(?<![\w.-])(?:0[1-9](?:(?:[ .-]\d\d){4}|\d{1,3}[ /-]\d{6,8}|\d{8,9})|\(0[1-9]\d{0,3}\) ?\d{5,8})(?![\w-]|\.\d))",
    re.ASCII,
)
#: A text without any of these holds none of the formats.
TRACE = re.compile(r"[0-9@]|[A-Fa-f]{32}|::?[A-Fa-f]")


# Country codes of one and two digits; all others have three (ITU-T E.164).
SHORT_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
#: Letters of a local part that are permuted among each other, small ones; capitals go with them.
ALPHABETS = (LETTERS, DIGITS, "".join(chr(c) for c in range(0xE0, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2), "".join(chr(c) for c in range(0x430, 0x450)))
PLACES = {c: (letters, i) for letters in ALPHABETS for i, c in enumerate(letters)}


def north_american(number: str) -> bool:
    """Ten digits with an area code and an exchange as they are assigned."""
    return len(number) == 10 and number[0] in "23456789" and number[1] != "9" and number[3] in "23456789" and number[4:6] != "11"


def country_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])


class Feistel:
    """Keyed permutation of range(n): a balanced network over a square at least as large, walked until it lands inside."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, i: int, tweak: bytes, x: int, m: int) -> int:
        size = (m.bit_length() + 71) // 8  # 64 bits more than m has: hardly any bias
        return int.from_bytes(hashlib.shake_256(self.key + bytes([i]) + tweak + x.to_bytes(size, "big")).digest(size), "big") % m

    def _walk(self, x: int, n: int, tweak: bytes, order: range, sign: int) -> int:
        if n < 2:
            return x
        m = int(n**0.5) if n < 1 << 50 else 1 << (n.bit_length() + 1) // 2
        while m * m < n:
            m += 1
        tweak = hashlib.sha256(len(tweak).to_bytes(8, "big") + tweak + n.to_bytes((n.bit_length() + 7) // 8, "big")).digest()
        while True:
            a, b = divmod(x, m)
            for i in order:
                if sign > 0:
                    a, b = b, (a + self._round(i, tweak, b, m)) % m
                else:
                    a, b = (b - self._round(i, tweak, a, m)) % m, a
            x = a * m + b
            if x < n:
                return x

    def forward(self, x: int, n: int, tweak: bytes) -> int:
        return self._walk(x, n, tweak, range(ROUNDS), 1)

    def back(self, x: int, n: int, tweak: bytes) -> int:
        return self._walk(x, n, tweak, range(ROUNDS)[::-1], -1)


def luhn(digits: str) -> int:
    """The check digit of these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def mod97(s: str) -> int:
    """The check digits of an IBAN's country and account."""
    return 98 - int("".join(str(int(c, 36)) for c in s[4:] + s[:2] + "00")) % 97


@cache
def days_of(order: str, widths: tuple[int, int]) -> list[int]:
    """Ordinals of the dates written in this order with so many digits of the first two numbers; two stand for padded ones too."""
    out = []
    for n in range(FIRST_DAY, FIRST_DAY + DAYS):
        d = date.fromordinal(n)
        pair = (d.day, d.month) if order == "dm" else (d.month, d.day)
        # 13/25/2001 is no date, and 03/04/2001 is taken for the third of April
        if (order == "dm" or d.day > 12) and (widths == (2, 2) or all(len(str(x)) == w for x, w in zip(pair, widths, strict=True))):
            out.append(n)
    return out


class Pseudonyms:
    def __init__(self, key: bytes, inverse: bool = False):
        feistel = Feistel(key)
        self.permute = feistel.back if inverse else feistel.forward

    def digits(self, s: str, tweak: bytes, base: int = 10) -> str:
        if not s:
            return s
        x = self.permute(int(s, base), base ** len(s), tweak)
        return f"{x:0{len(s)}{'x' if base == 16 else 'd'}}"

    @staticmethod
    def refill(shape: str, digits: str) -> str:
        """The digits into the places that the shape's digits hold."""
        left = iter(digits)
        return "".join(next(left) if c.isdigit() else c for c in shape)

    def iban(self, s: str) -> str | None:
        flat = s.replace(" ", "")
        if not 15 <= len(flat) <= 34 or int(flat[2:4]) != mod97(flat):
            return None
        account = flat[4:]
        new = self.refill(account, self.digits(re.sub(r"\D", "", account), b"iban" + flat[:2].encode() + re.sub(r"\d", "0", account).encode()))
        left = iter(flat[:2] + f"{mod97(flat[:4] + new):02d}" + new)
        return "".join(c if c == " " else next(left) for c in s)

    def card(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if int(d[-1]) != luhn(d[:-1]):
            return None
        new = self.digits(d[:-1], b"card")
        return self.refill(s, new + str(luhn(new)))

    def phone(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if not 9 < len(d) < 16:
            return None
        if s[0] == "+":
            code, kept_ = country_code(d), len(country_code(d))
        elif d[0] == "0":
            code, kept_ = "0", 1  # a national number's 0 stays
        else:
            code, kept_ = "1", len(d) - 10
            if not re.search("[().-]", s) and not north_american(d[kept_:]):
                return None
        number = d[kept_:]
        kind = lambda x: (x[0] == "0", north_american(x))
        new = number
        while True:  # walks on along the permutation to the next number of the same kind
            new = self.digits(new, b"phone" + code.encode())
            if kind(new) == kind(number):
                return self.refill(s, d[:kept_] + new)

    def ip(self, s: str) -> str | None:
        if ":" in s:
            try:
                ipaddress.IPv6Address(s)
            except ValueError:
                return None
            new = iter(self.digits(s.replace(":", "").lower(), b"ip6" + re.sub("[^:]", "0", s).encode(), 16))
            new = "".join(c if c == ":" else next(new) for c in s)
            return new.upper() if s.upper() == s else new
        parts = [int(x) for x in s.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
            return None
        return ".".join(map(str, self.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip").to_bytes(4, "big")))

    def ssn(self, s: str) -> str | None:
        area, group, serial = map(int, s.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self.permute(x, 898 * 99 * 9999, b"ssn"), 9999)
        area, group = divmod(x, 99)
        area += 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def date(self, s: str) -> str | None:
        mark = next(c for c in s if not c.isdigit())
        parts = s.split(mark)
        if mark == "-":
            order, widths, (y, m, d) = "dm", (2, 2), map(int, parts)
        else:
            order = "md" if mark == "/" and int(parts[1]) > 12 else "dm"
            widths, y = (len(parts[0]), len(parts[1])), int(parts[2])
            d, m = map(int, parts[:2] if order == "dm" else parts[1::-1])
        try:
            day = date(y, m, d).toordinal()
        except ValueError:
            return None
        days = days_of(order, widths)
        at = bisect_left(days, day)
        if at == len(days) or days[at] != day:  # as in 03.7.2001, where 0 fills up one number alone
            return None
        new = date.fromordinal(days[self.permute(at, len(days), f"date{order}{widths}".encode())])
        if mark == "-":
            return f"{new:%Y-%m-%d}"
        pair = (new.day, new.month) if order == "dm" else (new.month, new.day)
        return mark.join([*(f"{x:0{w}d}" for x, w in zip(pair, widths, strict=True)), str(new.year)])

    def email(self, s: str) -> str:
        local, _, domain = s.partition("@")
        # a letter whose small form is another length or has another capital stays as it is
        places = [PLACES.get(c.lower()) if c.lower() == c or c.lower().upper() == c else None for c in local]
        n, x = 1, 0
        for place in places:
            if place:
                letters, i = place
                x, n = x * len(letters) + i, n * len(letters)
        # the tweak is what stays: domain, marks and the kinds of the places
        shape = "".join(letters[0] if place and (letters := place[0]) else c for c, place in zip(local, places, strict=True))
        x = self.permute(x, n, b"email" + shape.encode() + b"@" + domain.lower().encode())
        out = []
        for c, place in zip(reversed(local), reversed(places), strict=True):
            if place:
                letters = place[0]
                x, i = divmod(x, len(letters))
                c = letters[i].upper() if c != c.lower() else letters[i]
            out.append(c)
        return "".join(reversed(out)) + "@" + domain

    def hex(self, s: str) -> str:
        new = self.digits(s.lower(), b"hex", 16)
        return new.upper() if s.upper() == s else new

    def text(self, s: str) -> tuple[str, list[tuple[str, str]]]:
        """The text with pseudonyms, and (kind, pseudonym) of each value that was validated."""
        found: list[tuple[str, str]] = []

        def put(m: re.Match) -> str:
            new = getattr(self, m.lastgroup)(m[0])
            if new is None:
                return m[0]
            found.append((m.lastgroup, new))
            return new

        return PATTERN.sub(put, s) if TRACE.search(s) else s, found


def pseudonymised(docs: DataFrame, key: bytes, inverse: bool = False) -> DataFrame:
    """(doc_id, text, n_values, one count for each kind, pseudonyms) of every document: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key, inverse)
        for b in slices(batches):
            new, counts, names = [], [], []
            for t in b.column("text").to_pylist():
                text, found = p.text(t) if t else (t, [])
                kinds = [k for k, _ in found]
                new.append(text)
                counts.append([len(kinds), *(kinds.count(k) for k in KINDS)])
                names.append([f"{k}:{v}" for k, v in found])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(new, pa.string()), *(pa.array(x, pa.int32()) for x in zip(*counts, strict=True)), pa.array(names, pa.list_(pa.string()))], ["doc_id", "text", "n_values", *(f"n_{k}" for k in KINDS), "pseudonyms"])

    counts = ", ".join(f"{c} int" for c in ("n_values", *(f"n_{k}" for k in KINDS)))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, {counts}, pseudonyms array<string>")


def op6_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """The key is a parameter of the operator; this one serves the query alone."""
    return pseudonymised(table(spark, sf_dir, "documents"), b"loomwork query key 1")
