"""Admission windows, landmark grids and labels."""

import datetime as dt

import pytest

from tests.conftest import hours, rows_of
from tidemark.operators import landmarks

EVENTS = "subject_id bigint, time timestamp_ntz, code string, end timestamp_ntz, visit_id bigint"
WINDOWS = "subject_id bigint, visit_id bigint, visit_code string, admittime timestamp_ntz, dischtime timestamp_ntz"
DATED = WINDOWS + ", diagtime timestamp_ntz"


def window(visit=1, start=0.0, end=120.0, code="Visit/IP", subject=1):
    return (subject, visit, code, None if start is None else hours(start), None if end is None else hours(end))


def test_windows_come_from_visit_events(frame):
    events = frame(EVENTS, [(1, hours(0), "Visit/IP", hours(5), 10), (1, hours(1), "Visit/OP", hours(2), 11),
                            (1, hours(1), "LOINC/1", hours(2), 10), (1, hours(1), "NotVisit/IP", hours(2), 12),
                            (1, hours(1), None, hours(2), 13)])
    got = landmarks.admission_windows(events)
    assert got.columns == ["subject_id", "visit_id", "visit_code", "admittime", "dischtime"]
    assert rows_of(got, "visit_id", "admittime", "dischtime") == [(10, hours(0), hours(5)), (11, hours(1), hours(2))]


def test_inpatient_and_forward_filters(frame):
    rows = [window(1), window(2, code="Visit/ERIP"), window(3, code="Visit/OP"), window(4, code="Visit/ER")]
    assert rows_of(landmarks.inpatient_windows(frame(WINDOWS, rows)), "visit_id") == [(1,), (2,)]
    rows = [window(1), window(2, 5, 5), window(3, 6, 5), window(4, None, 5), window(5, 0, None)]
    assert rows_of(landmarks.forward_windows(frame(WINDOWS, rows)), "visit_id") == [(1,)]


@pytest.mark.parametrize("died,flag", [
    (dt.datetime(2025, 1, 1), True),    # the day of admission
    (dt.datetime(2025, 1, 6), True),    # the day of discharge, at midnight
    (dt.datetime(2025, 1, 3), True),
    (dt.datetime(2024, 12, 31), False),
    (dt.datetime(2025, 1, 7), False),
    (None, False),
])
def test_death_is_compared_by_date(frame, died, flag):
    events = frame(EVENTS, [(1, died, "MEDS_DEATH", None, None), (2, hours(30), "MEDS_DEATH", None, None),
                            (1, hours(30), "OTHER", None, None)])
    got = landmarks.flag_death(frame(WINDOWS, [window(start=10, end=130)]), events)
    assert rows_of(got, "died_in_hospital") == [(flag,)]


def test_repeated_deaths_do_not_multiply(frame):
    events = frame(EVENTS, [(1, hours(24), "MEDS_DEATH", None, None)] * 3)
    assert landmarks.flag_death(frame(WINDOWS, [window(1), window(2)]), events).count() == 2


def test_onset_join_keeps_windows_and_matches_both_keys(frame):
    diagnoses = frame("subject_id bigint, visit_id bigint, timestamp timestamp_ntz", [(1, 1, hours(60)), (2, 2, hours(70))])
    got = landmarks.join_onset(frame(WINDOWS, [window(1), window(2)]), diagnoses)
    assert rows_of(got, "visit_id", "diagtime") == [(1, hours(60)), (2, None)]


def grid(frame, end=120.0, onset=None, step="12h"):
    df = frame(DATED, [(*window(end=end), None if onset is None else hours(onset))])
    return [r["prediction_time"] for r in landmarks.landmark_grid(df, step).orderBy("prediction_time").collect()]


@pytest.mark.parametrize("end,onset,step,want", [
    (120, None, "12h", [48, 60, 72, 84, 96, 108]),   # discharge itself is left out
    (121, None, "12h", [48, 60, 72, 84, 96, 108, 120]),
    (120, 72, "12h", [48, 60]),                      # onset itself is left out
    (120, 200, "12h", [48, 60, 72, 84, 96, 108]),
    (48, None, "12h", []),
    (20, None, "12h", []),
    (120, 30, "12h", []),
    (100, None, "1d", [48, 72, 96]),
    (48.001, None, "12h", [48]),
])
def test_grid(frame, end, onset, step, want):
    assert grid(frame, end, onset, step) == [hours(h) for h in want]


def labelled(frame, at=48.0, end=120.0, onset=None, horizon="48h"):
    df = frame(DATED + ", prediction_time timestamp_ntz",
               [(*window(end=end), None if onset is None else hours(onset), hours(at))])
    row = landmarks.label_horizon(df, horizon).first()
    return row["horizon_time"], row["horizon_hours"], row["boolean_value"]


@pytest.mark.parametrize("at,end,onset,horizon,want", [
    (48, 120, None, "48h", (96, 48.0, False)),
    (48, 120, 96, "48h", (96, 48.0, True)),      # the end of the horizon counts
    (48, 120, 96.001, "48h", (96, 48.0, False)),
    (96, 120, 110, "48h", (120, 24.0, True)),    # cut short by discharge
    (48, 500, 200, "1w", (216, 168.0, True)),
    (48, 500, 72, "2d", (96, 48.0, True)),
])
def test_horizon(frame, at, end, onset, horizon, want):
    assert labelled(frame, at, end, onset, horizon) == (hours(want[0]), *want[1:])


def test_horizon_refuses_unknown_units(frame):
    with pytest.raises(ValueError):
        labelled(frame, horizon="48m")


def test_whole_grid_and_summary(frame):
    events = frame(EVENTS, [
        (1, hours(0), "Visit/IP", hours(100), 1), (1, hours(96), "MEDS_DEATH", None, None),
        (2, hours(0), "Visit/ERIP", hours(100), 2), (2, hours(0), "Visit/OP", hours(100), 3)])
    diagnoses = frame("subject_id bigint, visit_id bigint, timestamp timestamp_ntz", [(2, 2, hours(70))])
    labels = landmarks.labelled_landmarks(events, diagnoses)
    assert rows_of(labels, "visit_id", "prediction_time", "died_in_hospital", "boolean_value") == [
        *[(1, hours(h), True, False) for h in (48, 60, 72, 84, 96)], (2, hours(48), False, True), (2, hours(60), False, True)]
    assert landmarks.label_summary(labels).first().asDict() == {
        "n_landmarks": 7, "n_positive": 2, "n_admissions": 2, "n_subjects": 2, "n_died": 5,
        "positive_rate": pytest.approx(200 / 7)}
    assert landmarks.label_summary(labels.limit(0)).first()["positive_rate"] == 0.0


def test_surviving_events(frame):
    diagnoses = frame("subject_id bigint, visit_id bigint", [(1, 1), (1, 2)])
    events = frame("visit_id bigint", [(1,), (1,), (None,), (3,)])
    assert rows_of(landmarks.count_surviving_events(diagnoses, events), "visit_id", "n_surviving_events") == [(1, 2.0), (2, 0.0)]
