"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted within their format by a keyed Feistel network.

Equal values get equal pseudonyms in every document, so links stay; a pseudonym is as valid as what it stands for;
and whoever holds the key can turn the permutation round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from hashlib import blake2b
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

# The formats that are looked for, in order of precedence. What a format cannot say is checked by :func:`swap`.
FORMATS = {
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])",
    "email": r"[\w.+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<=[\"'])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?=[\"'])",
    "phone": r"(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4})(?![0-9])",
}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in FORMATS.items()))
_SEED = re.compile("[0-9@]")

# Letters and digits that may take each other's place, by class.
_ALPHABETS = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7),
]
_PLACE = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}


# Permutation ----------------------------------------------------------------------------------


def _draw(key: bytes, turn: int, tweak: str, value: int, below: int) -> int:
    size = (below.bit_length() + 7) // 8 + 16
    data, out, block = f"{turn}|{below}|{tweak}|{value}".encode("utf-8", "surrogatepass"), b"", 0
    while len(out) < size:
        out += blake2b(data + b"|%d" % block, key=key, digest_size=64).digest()
        block += 1
    return int.from_bytes(out[:size], "big") % below


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """The keyed permutation of 0..size-1 for a tweak, or its inverse.

    Two halves of about equal size take turns in adding a keyed hash of the other. Results beyond the size
    are permuted again until they fall inside, which keeps it one to one.
    """
    if size < 2:
        return value
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * _draw(key, turn, tweak, left, b)) % b
            else:
                left = (left + sign * _draw(key, turn, tweak, right, a)) % a
        value = left * b + right
        if value < size:
            return value


# Formats as ranks -----------------------------------------------------------------------------


def _chars_rank(text: str) -> tuple[int, int, str]:
    """(rank, size, shape): place among the texts with the same class at each character; other characters belong to the shape."""
    rank, size, shape = 0, 1, []
    for c in text:
        alphabet, i = _PLACE.get(c, (None, 0))
        if alphabet is None:
            shape.append("=" + c)
        else:
            rank, size = rank * len(alphabet) + i, size * len(alphabet)
            shape.append(alphabet[0])
    return rank, size, "".join(shape)


def _chars_unrank(rank: int, text: str) -> str:
    out = []
    for c in reversed(text):
        alphabet = _PLACE.get(c, (None, 0))[0]
        if alphabet is None:
            out.append(c)
        else:
            rank, i = divmod(rank, len(alphabet))
            out.append(alphabet[i])
    return "".join(reversed(out))


def _luhn_digit(digits: str) -> str:
    """The digit that completes a number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 if i % 2 else 2)
        total += v - 9 if v > 9 else v
    return str(-total % 10)


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _fill(shape: str, digits: str) -> str:
    """Digits put in the places of a shape's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _date_parts(text: str) -> tuple[str, tuple[int, int, int]]:
    if text[4] == "-":
        return "-", (int(text[:4]), int(text[5:7]), int(text[8:]))
    return text[2], (int(text[6:]), int(text[3:5]), int(text[:2]))


def swap(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, the value of a pseudonym, or None when the text is not a valid value of its kind."""
    go = lambda rank, size, tweak: permute(rank, size, key, f"{kind}|{tweak}", back)
    if kind == "card":
        digits = _only_digits(text)
        if _luhn_digit(digits[:-1]) != digits[-1]:
            return None
        n = len(digits) - 1
        body = f"{go(int(digits[:-1]), 10**n, n):0{n}d}"
        return _fill(text, body + _luhn_digit(body))
    if kind == "phone":
        return "+1" + _fill(text[2:], f"{go(int(_only_digits(text[2:])), 10**10, ''):010d}")
    if kind == "ip":
        parts = text.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        v = go(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "")
        return ".".join(map(str, v.to_bytes(4, "big")))
    if kind == "ssn":
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        v = go(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "")
        v, serial = divmod(v, 9999)
        area, group = divmod(v, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "date":
        sep, (y, m, d) = _date_parts(text)
        try:
            day = date(y, m, d).toordinal()
        except ValueError:
            return None
        low = date(max(1, y // 200 * 200), 1, 1).toordinal()
        high = date(y // 200 * 200 + 199, 12, 31).toordinal()
        new = date.fromordinal(low + go(day - low, high - low + 1, y // 200))
        return f"{new.year:04d}-{new.month:02d}-{new.day:02d}" if sep == "-" else f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year:04d}"
    if kind == "iban":
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return None
        rank, size, shape = _chars_rank(plain[4:])
        rest = _chars_unrank(go(rank, size, plain[:2] + shape), plain[4:])
        new = iter(plain[:2] + _iban_check(plain[:2], rest) + rest)
        return "".join(c if c == " " else next(new) for c in text)
    if kind == "secret":
        return f"{go(int(text, 16), 16 ** len(text), len(text)):0{len(text)}{'x' if text == text.lower() else 'X'}}" if not text.isdigit() else None
    local, at, domain = text.partition("@")
    rank, size, shape = _chars_rank(local)
    return _chars_unrank(go(rank, size, f"{shape}@{domain}"), local) + at + domain


def find(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what looks like a value, left to right, without overlaps; validity is not checked."""
    if _SEED.search(text):
        for m in _FIND.finditer(text):
            yield m.start(), m.end(), next(k for k in FORMATS if m[k] is not None)


def pseudonymise_text(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with every valid value replaced, and (start, end, kind) of each value in the text that came in."""
    out, last, spans = [], 0, []
    for start, end, kind in find(text):
        if (new := swap(kind, text[start:end], key, back)) is not None:
            out += [text[last:start], new]
            last = end
            spans.append((start, end, kind))
    return "".join([*out, text[last:]]) if spans else text, spans


SPANS = "array<struct<start:int,end:int,kind:string>>"


def pseudonymised(text: Column, key: bytes, back: bool = False) -> Column:
    """Struct (text, spans); null stays null, with no spans. Offsets count code points of the text that came in."""

    @F.pandas_udf(f"text string, spans {SPANS}")
    def of(texts: pd.Series) -> pd.DataFrame:
        done = [(None, []) if t is None else pseudonymise_text(t, key, back) for t in texts]
        return pd.DataFrame({"text": pd.Series([t for t, _ in done], dtype=object), "spans": [[{"start": s, "end": e, "kind": k} for s, e, k in x] for _, x in done]})

    return of(text)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str = "pii_spans", back: bool = False) -> DataFrame:
    """Documents with pseudonyms in ``text``, and the places of the values in a new column; ``back`` restores them.

    A row depends on itself and the key alone, so nothing is shuffled. Null texts stay null; other columns pass
    through; an empty table stays empty. A column named like ``spans`` is replaced.
    """
    done = docs.withColumn("__pii", pseudonymised(F.col(text), key, back))
    return done.withColumn(text, F.col("__pii.text")).withColumn(spans, F.col("__pii.spans")).drop("__pii")
