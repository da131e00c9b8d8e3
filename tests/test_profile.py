"""Profiling questions."""

import math

import pytest

from tests.conftest import hours, rows_of
from tidemark.operators import profile
from tidemark.operators.profile import EmptyHistogramError, EventProfile, MixedUnitsError

SCHEMA = ("patient_id string, event_type string, timestamp timestamp_ntz, hadm_id string, `lab/value` double, "
          "`lab/label` string, `lab/uom` string, `adm/kind` string")
ROWS = [
    ("1", "lab", hours(3), "24", 1.0, "K", "mg", None),
    ("1", "lab", hours(1), "24", 2.0, "K", "mg", None),
    ("2", "lab", hours(2), "25", 3.0, "K", "mg", None),
    ("2", "lab", hours(2), "25", 4.0, "K", "mg", None),
    ("2", "lab", hours(2), "25", 9.0, "Na", "g", None),
    ("2", "lab", hours(2), "25", None, "Na", "mg", None),
    ("2", "adm", hours(0), "25", None, None, None, "x"),
    ("1", "adm", hours(0), "24", None, None, None, None),
    ("3", "adm", hours(0), "26", None, None, None, "x"),
]


@pytest.fixture
def source(frame):
    return EventProfile(frame(SCHEMA, ROWS))


def test_counts(source):
    assert source.event_types() == ["adm", "lab"]
    assert (source.n_events("lab"), source.n_patients("lab")) == (6, 2)
    assert rows_of(source.counts()) == [("adm", 3, 3), ("lab", 6, 2)]
    assert source.n_events("none") == 0


def test_refuses_bad_frames(frame):
    with pytest.raises(KeyError):
        EventProfile(frame("patient_id string", [("1",)]))
    with pytest.raises(ValueError):
        EventProfile(frame("patient_id string, event_type string", [(None, "a"), ("1", "a")]))


def test_distinct_values(source):
    got = [tuple(r) for r in source.distinct_values(["lab/label", "lab/uom"]).collect()]
    assert got == [("K", "mg"), ("Na", "g"), ("Na", "mg")]
    assert rows_of(source.distinct_values(["lab/label"], {"lab/uom": "g"})) == [("Na",)]


def test_field_catalogue(source):
    assert source.fields("lab") == ["lab/label", "lab/uom", "lab/value"]
    assert rows_of(source.field_types("adm")) == [("adm/kind", "string")]
    assert source.is_numeric("lab/value") and not source.is_numeric("lab/label")
    with pytest.raises(KeyError):
        source.is_numeric("lab/none")


def test_summarisable_fields(frame):
    df = frame("patient_id string, event_type string, `a/x_id` string, `a/day` date, `a/at` timestamp_ntz, `a/v` double, "
               "`labevents/valueuom` string", [("1", "a", None, None, None, None, None)])
    assert EventProfile(df).summarisable_fields("a") == ["a/v"]
    assert EventProfile(df).summarisable_fields("labevents") == []


def test_shares_count_nulls_of_own_type_only(source):
    got = [tuple(r) for r in source.describe_categorical("adm/kind").collect()]
    assert got == [("x", pytest.approx(2 / 3)), (None, pytest.approx(1 / 3))]
    with pytest.raises(ValueError):
        source.describe_categorical("lab/value")


def test_describe_numeric(source):
    summary = source.describe_numeric("lab/value", {"lab/label": "K"}, "lab/uom")
    row = summary.stats.first().asDict()
    assert summary.unit == "mg"
    assert row == {"count": 4, "null_count": 0, "mean": 2.5, "std": pytest.approx(1.2909944), "min": 1.0,
                   "p25": 1.75, "p50": 2.5, "p75": 3.25, "max": 4.0}
    with pytest.raises(MixedUnitsError) as caught:
        source.describe_numeric("lab/value", {"lab/label": "Na"}, "lab/uom")
    assert caught.value.units == ["g", "mg"]
    empty = source.describe_numeric("lab/value", {"lab/label": "none"}, "lab/uom")
    assert empty.unit is None and empty.stats.first()["count"] == 0


def test_histogram(source):
    assert rows_of(source.histogram("lab/value", {"lab/label": "K"}, 2)) == [(1, 2.5, 2), (2, 4.0, 2)]
    with pytest.raises(EmptyHistogramError):
        source.histogram("lab/value", {"lab/label": "none"})


def test_histogram_of_one_value(frame):
    got = rows_of(profile.equal_width_histogram(frame("v double", [(5.0,)] * 3), "v", 2))
    assert got == [(1, 5.0, 3), (2, 5.5, 0)]


@pytest.mark.parametrize("rows_per_block", [3, None])
def test_grouped_quantiles(frame, rows_per_block):
    rows = [("a", float(i % 17)) for i in range(100)] + [("b", 1.0), ("b", 2.0), (None, 7.0), ("a", None)]
    got = {r[0]: tuple(r[1:]) for r in profile.exact_quantiles(
        frame("g string, v double", rows), "v", [0.0, 0.5, 1.0], by=["g"], rows_per_block=rows_per_block).collect()}
    middle = sorted(i % 17 for i in range(100))
    assert got == {"a": (0.0, (middle[49] + middle[50]) / 2, 16.0), "b": (1.0, 1.5, 2.0), None: (7.0, 7.0, 7.0)}


def test_timeline_is_sorted(source):
    assert [r["timestamp"] for r in source.timeline("24").collect()] == [hours(0), hours(1), hours(3)]
    with pytest.raises(ValueError):
        EventProfile(source.events.drop("timestamp")).timeline("24")


def test_preview_is_strictly_above_the_share(frame):
    names = ", ".join(f"`t/{c}` string" for c in "abcde")
    rows = [("1", "t", "x", "x", "x", None, None), ("1", "t", "x", "x", "x", "x", None)]
    got = EventProfile(frame(f"patient_id string, event_type string, {names}", rows)).preview("t")
    assert rows_of(got) == [("x", "x", "x", "x", None)]


@pytest.mark.parametrize("kind", ["spread", "ties", "one"])
def test_quantiles_of_many_values_are_exact(spark, kind):
    """More values than are bracketed whole: most are only counted, the quantiles are those of a full sort."""
    n = 30_001
    value = {"spread": lambda i: (i * 7919) % n / 3.0, "ties": lambda i: float((i * i) % 11), "one": lambda i: 4.5}[kind]
    rows = spark.createDataFrame([("g" if i % 3 else "h", value(i)) for i in range(n)] + [("g", None), ("e", None)], "g string, v double").repartition(5)
    shares = [0.9, 0.0, 0.25, 0.5, 0.999, 1.0]

    def by_hand(values):
        ordered, out = sorted(values), []
        for s in shares:
            place = s * (len(ordered) - 1)
            low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
            out.append(low + (high - low) * (place - math.floor(place)))
        return tuple(out)

    assert profile.exact_quantiles(rows, "v", shares).first()[:] == by_hand([value(i) for i in range(n)])
    got = {r[0]: tuple(r)[1:] for r in profile.exact_quantiles(rows, "v", shares, by=["g"]).collect()}
    assert got == {g: by_hand([value(i) for i in range(n) if (i % 3 > 0) == (g == "g")]) for g in "gh"}


def test_a_description_reads_the_source_twice(spark, tmp_path):
    """Two jobs read the files; what comes back reads none."""
    path = str(tmp_path / "numbers")
    spark.range(5000).selectExpr("'a' AS patient_id", "'lab' AS event_type", "cast(id % 700 AS double) AS `lab/v`", "'mg' AS `lab/u`").write.parquet(path)
    summary = profile.EventProfile(spark.read.parquet(path)).describe_numeric("lab/v", {}, "lab/u")
    assert "FileScan" not in summary.stats._jdf.queryExecution().executedPlan().toString()
    assert summary.unit == "mg" and summary.stats.first()[:2] == (5000, 0) and summary.stats.first()["p50"] == 342.0
