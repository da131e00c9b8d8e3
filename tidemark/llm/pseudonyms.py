"""Replace personal numbers, addresses and dates by keyed pseudonyms of the same format.

Each value that passes its kind's check (Luhn, mod 97, area rules, the calendar) is numbered within all
values of its format, the number is permuted by a keyed Feistel network, and the permuted number is
written in the format again. It passes the same check, equal values have equal pseudonyms in every
document, different values different ones, and the holder of the key can go back.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from bisect import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import keyed

ROUNDS = 8
# Dates of 1900 to 2099 are permuted among themselves.
FIRST_DAY = dt.date(1900, 1, 1).toordinal()
DAYS = dt.date(2099, 12, 31).toordinal() - FIRST_DAY + 1


class Feistel:
    """A keyed permutation of the numbers below any ``size``, by a balanced network and cycle walking."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, kind: str, size: int, number: int, half: int, bits: int) -> int:
        message = f"{kind}:{size}:{number}:{half}".encode()
        width = (bits + 7) // 8
        digest = b"".join(
            hashlib.blake2b(message, key=self.key, salt=i.to_bytes(8, "big"), digest_size=64).digest() for i in range((width + 63) // 64)
        )
        return int.from_bytes(digest[:width], "big") & ((1 << bits) - 1)

    def permute(self, kind: str, size: int, x: int, back: bool = False, valid: Callable[[int], bool] = lambda x: True) -> int:
        """The partner of ``x`` among the numbers below ``size`` that are ``valid``; ``x`` must be one."""
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            left, right = x >> bits, x & ((1 << bits) - 1)
            if back:
                for i in reversed(range(ROUNDS)):
                    left, right = right ^ self._round(kind, size, i, left, bits), left
            else:
                for i in range(ROUNDS):
                    left, right = right, left ^ self._round(kind, size, i, right, bits)
            x = left << bits | right
            if x < size and valid(x):
                return x


def luhn(digits: str) -> int:
    """The check digit that ``digits`` call for."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    lot = iter(digits)
    return "".join(next(lot) if c.isdigit() else c for c in shape)


def _ordinals(text: str) -> tuple[list[int], int]:
    """The sizes of the alphabets of the letters and digits of an ASCII text, and its number among all."""
    sizes, number = [], 0
    for c in text:
        size, rank = (10, ord(c) - 48) if c.isdigit() else (26, ord(c) - (97 if c.islower() else 65)) if c.isalpha() else (1, 0)
        sizes.append(size)
        number = number * size + rank
    return sizes, number


def _spelled(shape: str, sizes: list[int], number: int) -> str:
    out = []
    for c, size in zip(reversed(shape), reversed(sizes)):
        number, rank = divmod(number, size)
        out.append(c if size == 1 else chr(rank + (48 if size == 10 else 97 if c.islower() else 65)))
    return "".join(reversed(out))


def _mixed(f: Feistel, kind: str, text: str, back: bool) -> str:
    sizes, number = _ordinals(text)
    total = 1
    for size in sizes:
        total *= size
    return _spelled(text, sizes, f.permute(kind, total, number, back)) if total > 1 else text


def _card(f: Feistel, m: re.Match, back: bool) -> str | None:
    digits = "".join(filter(str.isdigit, m[0]))
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    body = str(f.permute("card", 10**n, int(digits[:-1]), back)).zfill(n)
    return _refill(m[0], body + str(luhn(body)))


def _iban(f: Feistel, m: re.Match, back: bool) -> str | None:
    text = m[0].replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(text) <= 34 or number(text[4:] + text[:4]) % 97 != 1:
        return None
    body = _mixed(f, "iban" + text[:2], text[4:], back)
    whole = text[:2] + f"{98 - number(body + text[:2] + '00') % 97:02d}" + body
    lot = iter(whole)
    return "".join(c if c == " " else next(lot) for c in m[0])


def _social(f: Feistel, m: re.Match, back: bool) -> str | None:
    def valid(x: int) -> bool:
        d = f"{x:09d}"
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    x = int(m[0].replace("-", "").replace(" ", ""))
    return _refill(m[0], f"{f.permute('ssn', 10**9, x, back, valid):09d}") if valid(x) else None


def _phone(f: Feistel, m: re.Match, back: bool) -> str | None:
    digits = "".join(filter(str.isdigit, m[0]))
    lead = 1 if digits.startswith("1") and len(digits) == 11 else 2 if m[0].startswith("+") else 0
    body = digits[lead:]
    national = len(body) == 10 and lead < 2

    def valid(x: int) -> bool:
        d = str(x).zfill(len(body))
        return not national or (d[0] in "23456789" and d[3] in "23456789")

    if not (national or m[0].startswith("+") and 8 <= len(digits) <= 15) or not valid(int(body)):
        return None
    return _refill(m[0], digits[:lead] + str(f.permute("phone", 10 ** len(body), int(body), back, valid)).zfill(len(body)))


def _address(f: Feistel, m: re.Match, back: bool) -> str | None:
    parts = [int(p) for p in m[0].split(".")]
    if any(p > 255 for p in parts) or any(len(p) > 1 and p[0] == "0" for p in m[0].split(".")):
        return None
    x = f.permute("ip", 1 << 32, int.from_bytes(bytes(parts), "big"), back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _mail(f: Feistel, m: re.Match, back: bool) -> str | None:
    return _mixed(f, "mail", m[1], back) + "@" + m[2]


def _date(f: Feistel, m: re.Match, back: bool) -> str | None:
    a, mark, b, c = m[1], m[2], m[3], m[4]
    if len(a) == 4:
        order, name = (0, 1, 2), "ymd"
    elif mark == "/" and int(a) <= 12:
        order, name = (2, 0, 1), "mdy"
    else:
        order, name = (2, 1, 0), "dmy"
    parts = (a, b, c)
    if sum(len(p) == 4 for p in parts) != 1 or len(parts[order[0]]) != 4:
        return None
    try:
        x = dt.date(*(int(parts[i]) for i in order)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    padded = tuple(len(p) == 2 for p in parts)

    def written(x: int) -> tuple[str, ...] | None:
        day = dt.date.fromordinal(FIRST_DAY + x)
        out = [""] * 3
        for i, value in zip(order, (day.year, day.month, day.day)):
            out[i] = f"{value:04d}" if i == order[0] else f"{value:02d}" if padded[i] else str(value)
        return tuple(out)

    def valid(x: int) -> bool:
        # Written alike, it must have parts as long and be read in the same order.
        out = written(x)
        alike = all(len(o) == len(p) for o, p in zip(out, parts))
        return alike and not (name == "dmy" and mark == "/" and int(out[0]) <= 12)

    if not 0 <= x < DAYS or not valid(x):
        return None
    shape = name + mark + "".join(str(len(p)) for p in parts)
    return mark.join(written(f.permute("date" + shape, DAYS, x, back, valid)))


# Kinds in the order they are tried; what one has taken the next ones leave.
KINDS: dict[str, tuple[re.Pattern, Callable]] = {
    "email": (re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*)@([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"), _mail),
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"), _iban),
    "card": (re.compile(r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z-])"), _card),
    "ip": (re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"), _address),
    "date": (re.compile(r"(?<![0-9A-Za-z./-])([0-9]{4}|[0-9]{1,2})([./-])([0-9]{1,2})\2([0-9]{4}|[0-9]{1,2})(?![0-9A-Za-z/-]|\.[0-9])"), _date),
    "ssn": (re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z-])"), _social),
    "phone": (re.compile(r"(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z-])"), _phone),
}

# Every value has a digit or this sign of an address. Few texts have either; the others stay as they are.
MAYBE = "[0-9@]"


def pseudonymise(text: str, f: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and the (kind, start, end) of what they replace in the given text."""
    taken: list[tuple[int, int, str, str]] = []
    for kind, (pattern, change) in KINDS.items():
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            place = bisect(taken, (m.start(), m.end()))
            if any(s < m.end() and m.start() < e for s, e, _, _ in taken[max(0, place - 1):place + 1]):
                continue
            new = change(f, m, back)
            if new is not None:
                taken.insert(place, (m.start(), m.end(), kind, new))
    out, at = [], 0
    for start, end, _, new in taken:
        out += (text[at:start], new)
        at = end
    out.append(text[at:])
    return "".join(out), [(kind, start, end) for start, end, kind, _ in taken]


def _replaced(key: bytes, back: bool):
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                texts = part.column("text")
                maybe = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False)
                changed = [pseudonymise(text, f, back) for text in texts.filter(maybe).to_pylist()]
                new = pc.replace_with_mask(texts, maybe, pa.array([text for text, _ in changed], texts.type))
                found = iter(changed)
                spans = [
                    [{"kind": k, "start": s, "end": e} for k, s, e in next(found)[1]] if some else [] for some in maybe.to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), new.cast(pa.string()), pa.array(spans, spans_type)], ["id", "text", "spans"]
                )

    return replace


def replace_personal_data(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """Per row of ``docs``: its id, ``text`` with pseudonyms, and ``spans``: (kind, start, end) in code
    points of the given text.

    Values that fail their kind's check stay. ``back`` undoes it with the same key. Null text stays null
    and has no spans. Repeated rows are answered each. Other columns are ignored. An empty table gives an
    empty result. What a document holds never leaves its row, so nothing is shuffled.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return (
        keyed(docs, id_col, text_col)
        .select("id", "text")
        .mapInArrow(_replaced(key, back), f"id {id_type}, text string, spans {spans}")
        .withColumnRenamed("id", id_col)
    )
