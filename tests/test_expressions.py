"""Column expressions against plain Python."""

import datetime as dt
from hashlib import sha256
from struct import pack

import pytest
from pyspark.sql import functions as F

from tests.conftest import hours
from tidemark.functions import expressions as X


def values(spark, schema, rows, expr):
    """The expression's value per row, in row order."""
    numbered = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, f"_i int, {schema}")
    return [r[0] for r in df.orderBy("_i").select(expr).collect()]


@pytest.mark.parametrize("text,want", [
    ("48h", dt.timedelta(hours=48)), ("2d", dt.timedelta(days=2)), ("1w", dt.timedelta(weeks=1)),
])
def test_duration(text, want):
    assert X.duration(text) == want


@pytest.mark.parametrize("text", ["48m", "h", "", "1.5h", "-2d", "2dd"])
def test_duration_refuses(text):
    with pytest.raises(ValueError):
        X.duration(text)


def test_cleaned_number(spark):
    cases = [
        ("13,000", 13000.0), ("1-3", 2.0), ("1 - 3", 2.0), ("-2", -2.0), ("1.5", 1.5), (".5", 0.5),
        ("-1 - 3", 1.0), ("1,000-3,000", 2000.0), ("13,000,000", 13000000.0), ("5", 5.0),
        (" ", None), ("", None), ("-", None), (",", None), ("abc", None), (None, None),
    ]
    got = values(spark, "t string", [(t,) for t, _ in cases], X.cleaned_number("t"))
    assert got == [w for _, w in cases]


def test_next_power_of_two(spark):
    got = values(spark, "n bigint", [(n,) for n in (1, 2, 3, 5, 9, 1000, 1024)], X.next_power_of_two(F.col("n")))
    assert got == [1, 2, 4, 8, 16, 1024, 1024]


def test_stable_hash(spark):
    ids = [0, 1, -1, 10**15, -(10**15), 2**63 - 1, -(2**63)]
    want = [sha256(pack(">q", 42) + pack(">q", i)).hexdigest()[:16] for i in ids]
    assert values(spark, "i bigint", [(i,) for i in ids], X.stable_hash(42, "i")) == want


def test_count_band(spark):
    assert values(spark, "n int", [(n,) for n in range(6)], X.count_band("n")) == ["0", "1", "2-3", "2-3", "4+", "4+"]


def test_floor_div(spark):
    got = values(spark, "n bigint", [(n,) for n in (-5, -4, -1, 0, 3, 4)], X.floor_div(F.col("n"), 4))
    assert got == [n // 4 for n in (-5, -4, -1, 0, 3, 4)]


def test_time_differences_truncate_toward_zero(spark):
    start = hours(0)
    ends = [start + dt.timedelta(seconds=s) for s in (59.9, 90, -90.5, 3600.999999)]
    rows = [(start, e) for e in ends]
    schema = "a timestamp_ntz, b timestamp_ntz"
    assert values(spark, schema, rows, X.seconds_between("a", "b")) == [59, 90, -90, 3600]
    assert values(spark, schema, rows, X.days_between("a", "b")) == [0, 1 / 1440, -1 / 1440, 60 / 1440]
    assert values(spark, schema, rows, X.hours_between("a", "b")) == [59 / 3600, 0.025, -0.025, 1.0]


def test_count_at_or_below(spark):
    rows = [([1.0, 3.0, 5.0], v) for v in (0.0, 1.0, 2.0, 5.0, 9.0, None)] + [([], 1.0), (None, 1.0)]
    got = values(spark, "a array<double>, v double", rows, X.count_at_or_below(F.col("a"), F.col("v"), 3))
    assert got == [0, 1, 1, 3, 3, 0, 0, 0]


def test_any_prefix_and_no_nulls(spark):
    rows = [("9", "5849"), ("10", "5849"), ("10", "N17"), ("9", None), (None, "N17")]
    prefix = X.any_prefix("v", "c", [("9", "584"), ("10", "N17")])
    assert [bool(x) for x in values(spark, "v string, c string", rows, prefix)] == [True, False, True, False, False]
    assert values(spark, "v string, c string", rows, X.no_nulls(["v", "c"])) == [True, True, True, False, False]
