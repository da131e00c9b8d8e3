"""Column expressions shared by the operators. All of them are built-in Spark functions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTES_PER_DAY = 1440
_MICROS_PER_SECOND = 1_000_000
_UNIT_KEYWORD = {"h": "hours", "d": "days", "w": "weeks"}


def duration(text: str) -> timedelta:
    """Read a duration such as ``48h``, ``2d`` or ``1w``."""
    match = re.fullmatch(r"(\d+)([a-z]+)", text)
    if match is None or match[2] not in _UNIT_KEYWORD:
        raise ValueError(f"{text!r} is not a duration; write a whole number followed by h, d or w.")
    return timedelta(**{_UNIT_KEYWORD[match[2]]: int(match[1])})


def duration_micros(text: str) -> int:
    return duration(text) // timedelta(microseconds=1)


def col(name: str | Column) -> Column:
    """A column by its exact name, so that ``labevents/value`` or ``a.b`` need no quoting."""
    return name if isinstance(name, Column) else F.col(f"`{name}`")


def micros(at: str | Column) -> Column:
    """Microseconds since the epoch (sessions run in UTC)."""
    return F.unix_micros(col(at).cast("timestamp"))


def _truncated(value: Column, unit: int) -> Column:
    return ((value - value % unit) / unit).cast("bigint")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Whole seconds from start to end, truncated toward zero."""
    return _truncated(micros(end) - micros(start), _MICROS_PER_SECOND)


def hours_between(start: str | Column, end: str | Column) -> Column:
    """Hours as a double, counted in whole seconds."""
    return seconds_between(start, end) / F.lit(3600.0)


def days_between(start: str | Column, end: str | Column) -> Column:
    """Days as a double, counted in whole minutes."""
    whole_minutes = _truncated(micros(end) - micros(start), 60 * _MICROS_PER_SECOND)
    return whole_minutes / F.lit(float(MINUTES_PER_DAY))


def floor_div(value: Column, divisor: int) -> Column:
    """Division rounded toward minus infinity."""
    return F.floor(value / F.lit(divisor)).cast("bigint")


def next_power_of_two(value: Column) -> Column:
    """The smallest power of two that is at least ``value``."""
    bits = F.length(F.bin(value - 1))
    return F.when(value <= 1, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1), bits))


def count_at_or_below(ascending: Column, value: Column, max_size: int) -> Column:
    """How many elements of an ascending array are <= ``value``; 0 when the value is null.

    A halving search: for each power of two, step over that many elements if the element
    reached is still at or below the value.
    """
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(max(1, max_size).bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda passed, step: F.when(
            F.get(ascending, passed + step - 1) <= value, passed + step
        ).otherwise(passed),
    )


# A number: an optional sign, then digits with an optional fraction, or a fraction alone.
_NUMBER = r"-?(?:\d+(?:\.\d+)?|\.\d+)"
# A dash behind a digit stands between the two ends of a range; any other dash is a sign.
_RANGE_DASH = r"(?<=\d)\s*-"


def cleaned_number(text: str | Column) -> Column:
    """A number out of messy text: no thousands commas, ``a-b`` becomes the mean, junk is null."""
    ends = F.split(F.translate(col(text), ",", ""), _RANGE_DASH)
    found = F.flatten(F.transform(ends, lambda end: F.regexp_extract_all(end, F.lit(_NUMBER), F.lit(0))))
    summed = F.aggregate(found, F.lit(0.0), lambda total, n: total + n.cast("double"))
    return F.try_divide(summed, F.size(found))


def stable_hash(seed: int, key: str | Column) -> Column:
    """First 64 bits of SHA-256 over the big-endian seed and key, as fixed-width hex text.

    Hex of one width sorts as the unsigned number it spells, so no unsigned type is needed.
    """
    as_hex = lambda number: F.lpad(F.hex(number), 16, "0")
    payload = F.unhex(F.concat(as_hex(F.lit(seed).cast("bigint")), as_hex(col(key).cast("bigint"))))
    return F.substring(F.sha2(payload, 256), 1, 16)


def count_band(count: str | Column) -> Column:
    """Band a count into ``0``, ``1``, ``2-3`` and ``4+``."""
    n = col(count)
    return (
        F.when(n == 0, "0").when(n == 1, "1").when(n.between(2, 3), "2-3").otherwise("4+")
    )


def z_score(value: Column, mean: float, std: float) -> Column:
    return (value - F.lit(mean)) / F.lit(std)


def all_equal(wanted: dict[str, object] | None) -> Column:
    """Conjunction of equality tests; no tests means every row passes."""
    condition = F.lit(True)
    for name, value in (wanted or {}).items():
        condition = condition & (col(name) == F.lit(value))
    return condition


def any_prefix(version: str, code: str, prefixes: Sequence[tuple[str, str]]) -> Column:
    """Whether (version, code) starts with one of the given (version, prefix) pairs."""
    condition = F.lit(False)
    for wanted_version, prefix in prefixes:
        condition = condition | (
            (col(version) == F.lit(wanted_version)) & col(code).startswith(prefix)
        )
    return condition


def no_nulls(names: Sequence[str]) -> Column:
    """True when every named column is set (NaN counts as set)."""
    condition = F.lit(True)
    for name in names:
        condition = condition & col(name).isNotNull()
    return condition
