"""Format-preserving pseudonyms for personal data by keyed Feistel networks.

Numbers are validated first (Luhn, IBAN check digits, octets, area codes, calendar dates);
what fails is left alone. A valid value is mapped to an index among all values of its
format, the index is permuted by a keyed Feistel network (cycle-walking inside the format)
and written back in the same layout, check digits renewed. The map is a permutation, so
equal values get equal pseudonyms in every document and different ones stay different.
Values are compared without their layout: a phone number by country code and digits, an e-mail
address without case, a date as a day. Days up to the 12th stay such days, and later ones later,
so that a pseudonym reads back in the order (day or month first) it was written in.
Each text is handled alone, so this runs where the texts are scanned.
"""

from __future__ import annotations

import datetime
import re
from bisect import bisect_left
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

KINDS = ("email", "phone", "ipv4", "card", "iban", "ssn", "date", "secret")
#: For tests and examples; a real run passes its own secret.
DEMO_KEY = b"tessera demo key"
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: The days permuted among each other: those up to the 12th of a month, and those after it.
_DAYS = tuple([n for n in range(FIRST_DAY, LAST_DAY + 1) if (datetime.date.fromordinal(n).day > 12) is late] for late in (False, True))


def permute(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): balanced Feistel rounds, walked until inside."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            digest = blake2b(tweak + b"|" + bytes([r]) + b"|" + right.to_bytes(width, "big"), key=key[:64], digest_size=min(64, width + 8)).digest()
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        x = left << half | right
        if x < size:
            return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, ch in enumerate(reversed(payload)):
        d = int(ch) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_rest(country: str, check: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def mixed(text: str, key: bytes, tweak: bytes) -> str:
    """Permutes the ASCII letters and digits of a string among strings of the same pattern."""
    size, x, layout = 1, 0, []
    for ch in text:
        for base, first in ((10, "0"), (26, "a"), (26, "A")):
            if 0 <= ord(ch) - ord(first) < base:
                x, size = x * base + ord(ch) - ord(first), size * base
                layout.append((base, first))
                break
        else:
            layout.append((1, ch))
    x, out = permute(x, size, key, tweak + b"|" + repr([b for b, _ in layout]).encode()), []
    for base, first in reversed(layout):
        x, d = divmod(x, base)
        out.append(chr(ord(first) + d))
    return "".join(reversed(out))


def digits(number: str, key: bytes, tweak: bytes) -> str:
    """Permutes a string of decimal digits among those of its length."""
    return str(permute(int(number), 10 ** len(number), key, tweak + b"|%d" % len(number))).zfill(len(number)) if number else ""


def relayout(model: str, new: str) -> str:
    """``model`` with its letters and digits replaced in turn by those of ``new``."""
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in model)


def email(s: str, key: bytes) -> str:
    """Permutes the lower-cased local part; letters keep their case, the domain stays."""
    local, _, domain = s.rpartition("@")
    new = mixed(local.translate(_LOWER), key, b"email|" + domain.lower().encode())
    return "".join(n.upper() if "A" <= c <= "Z" else n for c, n in zip(local, new)) + "@" + domain


_LOWER = {u: u + 32 for u in range(ord("A"), ord("Z") + 1)}
#: Country calling codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone(s: str, key: bytes) -> str | None:
    """Permutes the digits behind the country code among numbers of that code and length. A
    number without a code is one of code 1; a trunk digit written as (0) is no part of it."""
    number = re.sub(r"\D", "", s)
    if not 7 <= len(number) <= 15:
        return None
    code, keep = "1", 0
    if s[0] == "+":
        code = number[:1 if number[0] in "17" else 2 if number[:2] in _TWO_DIGIT_CODES else 3]
        keep = len(code) + bool(re.match(r"\+%s[ .-]?\(0\)" % code, s))
    return relayout(s, number[:keep] + digits(number[keep:], key, b"phone|" + code.encode()))


def ipv4(s: str, key: bytes) -> str | None:
    octets = [int(x) for x in s.split(".")]
    if max(octets) > 255:
        return None
    x = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, b"ipv4")
    return ".".join(map(str, x.to_bytes(4, "big")))


#: Number prefixes of payment cards, as (first, last, digits).
CARD_PREFIXES = ((4, 4, (13, 16, 19)), (51, 55, (16,)), (2221, 2720, (16,)), (34, 34, (15,)), (37, 37, (15,)), (3528, 3589, (16, 17, 18, 19)), (300, 305, (14,)), (36, 36, (14,)), (38, 39, (14,)),
                 (6011, 6011, (16, 19)), (644, 659, (16, 19)), (62, 62, (16, 17, 18, 19)))


def card(s: str, key: bytes) -> str | None:
    """Issuer prefix, length and Luhn digit must hold; the six issuer digits stay."""
    number = re.sub(r"\D", "", s)
    issued = any(lo <= int(number[:len(str(lo))]) <= hi and len(number) in sizes for lo, hi, sizes in CARD_PREFIXES)
    if not issued or luhn_digit(number[:-1]) != number[-1]:
        return None
    body = number[:6] + digits(number[6:-1], key, b"card|" + number[:6].encode())
    return relayout(s, body + luhn_digit(body))


#: Characters of an IBAN by country (ISO 13616 registry).
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}


def iban(s: str, key: bytes) -> str | None:
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_rest(plain[:2], plain[2:4], plain[4:]) != 1:
        return None
    body = mixed(plain[4:], key, b"iban|" + plain[:2].encode())
    check = 98 - iban_rest(plain[:2], "00", body)
    return relayout(s, f"{plain[:2]}{check:02d}{body}")


def ssn(s: str, key: bytes) -> str | None:
    a, b, c = map(int, s.split("-"))
    if a in (0, 666) or a > 899 or not b or not c:
        return None
    area = a - 1 - (a > 666)
    x = permute((area * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999, key, b"ssn")
    x, c = divmod(x, 9999)
    area, b = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{b + 1:02d}-{c + 1:04d}"


def date(s: str, key: bytes) -> str | None:
    a, sep, b, _, c = re.fullmatch(r"(\d+)([-/.])(\d+)([-/.])(\d+)", s).groups()
    year_first = len(a) == 4
    y, m, d = (a, b, c) if year_first else (c, b, a)
    order = "ymd" if year_first else "dmy"
    if not year_first and int(m) > 12:
        m, d, order = d, m, "mdy"
    try:
        day = datetime.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    late = int(d) > 12
    days = _DAYS[late]
    new = datetime.date.fromordinal(days[permute(bisect_left(days, day), len(days), key, b"date|%d" % late)])
    part = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return sep.join(part[x] for x in order)


def secret(s: str, key: bytes) -> str:
    return mixed(s, key, b"secret")


#: One alternation; each named group is one kind. Numbers must not touch further word characters.
PATTERN = re.compile(r"""
    (?P<iban>\b[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?\b)
  | (?P<ipv4>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))
  | (?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?![\w/-]|\.\d))
  | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
  | (?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|3\d{3}[ -]\d{6}[ -]\d{4,5})(?![\w-]))
  | (?P<phone>(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w|\.\d)
      |(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,4}){2,5}(?!\w|\.\d)
      |(?<![\w(])\(\d{3}\)\ ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))
""", re.X | re.A)
EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_RUN = re.compile(r"\d+", re.A)
#: Between two groups of a phone number; a dot and a digit do not end one.
_GAP = re.compile(r"[ -]", re.A)
SECRET = re.compile(r"""(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)["']?\s*[:=]\s*["']?([A-Za-z0-9+/_-]{16,})(?![A-Za-z0-9+/_-])""", re.A)
_MAKE = {"phone": phone, "ipv4": ipv4, "card": card, "iban": iban, "ssn": ssn, "date": date}


def ends(m: re.Match, kind: str):
    """Where the value of a match may end, best first: the pattern also takes words and numbers
    that follow an IBAN or an international phone number, so an IBAN may end at its country's
    length, and a phone number before any of its later groups."""
    if kind == "iban" and (n := IBAN_LENGTHS.get(m[0][:2])):
        value = re.match(r"(?: ?[A-Z0-9]){%d}(?= )" % n, m[0])
        if value:
            yield m.start() + value.end()
    yield m.end()
    if kind == "phone" and m[0][0] == "+":
        for gap in reversed(list(_GAP.finditer(m.string, *m.span()))):
            if PATTERN.fullmatch(m.string, m.start(), gap.start()):
                yield gap.start()


def numbers(text: str, key: bytes):
    """(start, end, kind, pseudonym) of the valid numbers and dates of a text.

    The pattern is tried only where a run of digits begins (or the sign before it), with each
    end that its match allows; where all fail, the search goes on behind that run.
    """
    at = 0
    while run := _RUN.search(text, at):
        d = run.start()
        for p in (d - 2, d - 1, d):
            if p >= at and (m := PATTERN.match(text, p)):
                kind = next(k for k in _MAKE if m[k])
                end, new = next(((e, v) for e in ends(m, kind) if (v := _MAKE[kind](text[p:e], key)) is not None), (p, None))
                if new is not None:
                    yield p, end, kind, new
                    at = end
                    break
        else:
            at = run.end()


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of a text's personal data, in order and without overlaps."""
    spans = list(numbers(text, key))
    if "@" in text:
        spans += [(*m.span(), "email", email(m[0], key)) for m in EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        spans += [(*m.span(1), "secret", secret(m[1], key)) for m in SECRET.finditer(text)]
    out: list[tuple[int, int, str, str]] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, dict[str, int]]:
    """The text with its valid values replaced, and how many of each kind; null stays null."""
    counts = dict.fromkeys(KINDS, 0)
    if not text:
        return text, counts
    out, last = [], 0
    for start, end, kind, new in find(text, key):
        out += [text[last:start], new]
        last = end
        counts[kind] += 1
    return "".join([*out, text[last:]]), counts


def pseudonymised(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """``docs`` with ``text`` replaced by its pseudonymised form and a struct ``pii_counts``.

    Null texts stay null and empty ones empty. Texts are handled one by one, so repeated rows
    stay repeated and ties cannot arise; all other columns pass through unchanged.
    """
    def run(batches):
        for batch in batches:
            rows = [pseudonymise(t, key) for t in batch.column(batch.num_columns - 1).to_pylist()]
            counts = pa.array([r[1] for r in rows], pa.struct([(k, pa.int64()) for k in KINDS]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r[0] for r in rows], pa.string()), counts], names=[*batch.schema.names, "pii_counts"])
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").cast("string").alias("text"))
    kind = T.StructType([*plain.schema.fields, T.StructField("pii_counts", T.StructType([T.StructField(k, T.LongType()) for k in KINDS]))])
    return plain.mapInArrow(run, kind)
