"""Urine rates, onset detection and its validation."""

import pytest

from tests.conftest import hours, rows_of
from tidemark.operators import scoring
from tidemark.plans import phenotype

URINE = "subject_id string, hadm_id string, stay_id string, charttime timestamp_ntz, valuenum double"
RATE = "patient_id string, hadm_id string, stay_id string, charttime timestamp_ntz, rate double, window_hours double, n_events bigint"
EVENTS = ("patient_id string, hadm_id string, event_type string, timestamp timestamp_ntz, `labevents/label` string, "
          "`labevents/valuenum` double, `diagnoses_icd/icd_version` string, `diagnoses_icd/icd_code` string")


def urine(*points, stay="s", hadm="h"):
    return [("p", hadm, stay, hours(h), float(v)) for h, v in points]


def weight(*points, hadm="h"):
    return [("p", hadm, "s", hours(h), float(v)) for h, v in points]


def rates(frame, weights, outputs, **options):
    got = phenotype.urine_rate(frame(URINE, weights), frame(URINE, outputs), **options)
    return {(r["stay_id"], r["charttime"]): (r["rate"], r["window_hours"], r["n_events"]) for r in got.collect()}


def test_rate_over_the_observed_span(frame):
    got = rates(frame, weight((0, 60)), urine((0, 30), (1, 30), (2, 30), (3, 30)))
    assert got["s", hours(0)] == (None, 0.0, 1)
    assert got["s", hours(3)] == (pytest.approx(120 / 60 / 3), 3.0, 4)


def test_window_is_closed_on_both_ends_and_drops_older_rows(frame):
    got = rates(frame, weight((0, 60)), urine((0, 1000), (1, 30), (7, 30)))
    assert got["s", hours(7)] == (pytest.approx(60 / 60 / 6), 6.0, 2)


def test_volumes_that_cancel_out_are_zero(frame):
    got = phenotype.urine_rate(frame(URINE, weight((0, 10))), frame(URINE, urine((0, 0.3), (3, -0.1), (6, -0.2)))).withColumnRenamed("subject_id", "patient_id")
    assert {r["charttime"]: r["rate"] for r in got.collect()}[hours(6)] == 0.0
    assert rows_of(phenotype.urine_onset(got), "uo_time") == [(hours(6),)]


def test_no_weight_zero_weight_and_negative_rate(frame):
    got = rates(frame, weight((0, 0), hadm="z") + weight((0, 60), hadm="n"),
                urine((0, 1), (1, 1)) + urine((0, 1), (1, 1), stay="z", hadm="z") + urine((0, 1), (1, -121), stay="n", hadm="n"))
    assert got["s", hours(1)][0] is None
    assert got["z", hours(1)][0] is None
    assert got["n", hours(1)][0] == pytest.approx(-2.0)


def test_stays_do_not_mix_but_share_weights(frame):
    got = rates(frame, weight((0, 60)), urine((0, 60), (1, 60)) + urine((1.5, 600), (2, 60), stay="t"))
    assert got["s", hours(1)][0] == pytest.approx(2.0)
    assert got["t", hours(2)][0] == pytest.approx(660 / 60 / 0.5)


def test_backfill_takes_the_next_urine_rows_weight(frame):
    got = rates(frame, weight((2, 50), (3, 100)), urine((0, 50), (1, 50), (4, 100)))
    assert got["s", hours(1)][0] == pytest.approx(100 / 100 / 1)


@pytest.mark.parametrize("rows_per_block", [3, None])
def test_rate_does_not_depend_on_blocks(frame, rows_per_block):
    outputs = urine(*[(h / 2, 20 + h % 7) for h in range(60)])
    got = rates(frame, weight((0, 60), (11, 70)), outputs, rows_per_block=rows_per_block)
    assert got["s", hours(20)] == (pytest.approx(sum(20 + h % 7 for h in range(28, 41)) / 70 / 6), 6.0, 13)


def labs(*points, hadm="h", label="Creatinine", patient="p"):
    return [(patient, hadm, "labevents", hours(h), label, v, None, None) for h, v in points]


def admitted(at=0, hadm="h", patient="p"):
    return [(patient, hadm, "admissions", hours(at), None, None, None, None)]


def onset(frame, rows, rate=(), detect=phenotype.detect_onset, **options):
    got = detect(frame(EVENTS, rows), frame(RATE, list(rate)), **options)
    return {r["hadm_id"]: r["timestamp"] for r in got.collect()}


STEADY = [(h, 1.25) for h in range(0, 168, 12)]


@pytest.mark.parametrize("points,want", [
    (STEADY, None),
    (STEADY + [(170, 1.55)], 170),              # rise of 0.3 within 48 h
    (STEADY + [(170, 1.54)], None),
    (STEADY + [(170, 1.9), (182, 1.9)], 170),   # the first of a sustained rise
    ([(0, 1.0), (48, 1.4)], None),              # exactly 48 h back is outside
    ([(0, 1.0), (47.9, 1.4)], 47.9),
    ([(0, 0.5), (60, 0.6), (100, 0.75)], 100),  # 1.5 times the baseline
    ([(0, 0.5), (60, 0.6), (100, 0.74)], None),
    ([(30, 0.4), (80, 0.5), (130, 0.65)], None),  # no baseline within 24 h, no rise of 0.3
    ([(24, 0.5), (73, 0.6), (122, 0.75)], 122),  # a value at 24 h is a baseline
    ([(10, 1.0), (10, 1.3)], 10),               # rows of one moment see each other
])
def test_creatinine_arm(frame, points, want):
    got = onset(frame, admitted() + labs(*points))
    assert got == ({} if want is None else {"h": hours(want)})


def test_creatinine_arm_ignores_other_labels_nulls_and_other_admissions(frame):
    rows = (admitted() + admitted(hadm="g") + labs((0, 1.0), (1, None)) + labs((2, 9.0), label="Sodium")
            + labs((2, 5.0), hadm="g"))
    assert onset(frame, rows) == {}


@pytest.mark.parametrize("rows_per_block", [4, None])
def test_many_admissions_and_blocks(frame, rows_per_block):
    rows = []
    for i in range(12):
        rows += admitted(hadm=f"h{i}") + labs(*STEADY, (150 + i, 1.6), hadm=f"h{i}")
    want = {f"h{i}": hours(150 + i) for i in range(12)}
    assert onset(frame, rows, rows_per_block=rows_per_block) == want


def test_single_precision_ratio(frame):
    draws = labs((0, 0.7), (1, 0.8), (100, 1.05))
    df = frame(EVENTS.replace("valuenum` double", "valuenum` float"), admitted() + draws)
    got = phenotype.detect_onset(df, frame(RATE, []))
    assert [r["timestamp"] for r in got.collect()] == [hours(100)]


def rate_row(h, rate, window=6.0, hadm="h"):
    return ("p", hadm, "s", hours(h), rate, window, 3)


@pytest.mark.parametrize("row,counts", [
    (rate_row(60, 0.2), True), (rate_row(60, 0.5), False), (rate_row(60, 0.0), True),
    (rate_row(60, -0.1), False), (rate_row(60, 0.2, 5.9), False), (rate_row(60, None), False),
])
def test_urine_arm(frame, row, counts):
    assert onset(frame, admitted(), [row]) == ({"h": hours(60)} if counts else {})


def test_the_earlier_arm_wins(frame):
    rise = admitted() + labs((0, 1.0), (70, 2.0))
    assert onset(frame, rise, [rate_row(60, 0.2)]) == {"h": hours(60)}
    assert onset(frame, rise, [rate_row(80, 0.2)]) == {"h": hours(70)}
    assert onset(frame, rise, [rate_row(80, 0.2, hadm="g")]) == {"h": hours(70), "g": hours(80)}


@pytest.mark.parametrize("at,kept", [(48, False), (48.1, True), (20, False)])
def test_acquired_onset_is_strictly_later_than_48_hours(frame, at, kept):
    rows = admitted() + labs((0, 1.0), (at, 2.0), (at + 30, 3.5))
    got = onset(frame, rows, detect=phenotype.detect_acquired_onset)
    assert got == ({"h": hours(at)} if kept else {})


def test_diagnosis_events_are_appended(frame):
    events = frame(EVENTS, admitted() + labs((0, 1.0), (60, 2.0)))
    both = phenotype.with_diagnoses(events, phenotype.diagnosis_events(events, frame(RATE, [])))
    assert rows_of(both.filter("event_type = 'diagnosis_made'"), "hadm_id", "timestamp", "diagnosis_made/diagnosis") == [
        ("h", hours(60), "Acute Kidney Injury")]
    assert both.count() == 4


IDS = "hadm_id string"


def ids(frame, text):
    return frame(IDS, [(c,) for c in text])


def test_confusion_counts_evaluable_admissions_once(frame):
    got = scoring.confusion_matrix(ids(frame, "aabx"), ids(frame, "accy"), ids(frame, "abcdd"))
    assert rows_of(got) == [("negative", 1, 1), ("positive", 1, 1)]


def test_metrics(frame):
    matrix = frame("predicted string, actual_positive bigint, actual_negative bigint",
                   [("positive", 6, 2), ("negative", 4, 8)])
    got = dict(rows_of(scoring.metrics(matrix)))
    assert got == pytest.approx({"sensitivity": 0.6, "specificity": 0.8, "precision": 0.75, "npv": 8 / 12,
                                 "f1": 12 / 18, "accuracy": 0.7, "prevalence": 0.5})


def test_metrics_are_null_without_a_denominator(frame):
    matrix = frame("predicted string, actual_positive bigint, actual_negative bigint",
                   [("positive", 0, 0), ("negative", 0, 5)])
    got = dict(rows_of(scoring.metrics(matrix)))
    assert [got[m] for m in ("sensitivity", "precision", "f1")] == [None, None, None]
    assert (got["specificity"], got["npv"], got["accuracy"], got["prevalence"]) == (1.0, 1.0, 1.0, 0.0)


def test_evaluable_and_truth(frame):
    events = frame(EVENTS, labs((0, 1.0), hadm="a") + labs((0, None), hadm="b") + labs((0, 1.0), hadm=None) + [
        ("p", "c", "diagnoses_icd", hours(0), None, None, "9", "5849"),
        ("p", "d", "diagnoses_icd", hours(0), None, None, "9", "N179"),
        ("p", "e", "diagnoses_icd", hours(0), None, None, "10", "N179"),
        ("p", None, "diagnoses_icd", hours(0), None, None, "10", "N179")])
    rate = frame(RATE, [rate_row(0, None, hadm="c")])
    assert rows_of(scoring.evaluable_admissions(events, rate)) == [("a",), ("c",)]
    assert rows_of(scoring.coded_admissions(events)) == [("c",), ("e",)]
    with pytest.raises(ValueError):
        scoring.require_same_population(ids(frame, "z"), events)


def test_validation_run(frame):
    rows = []
    for hadm, rise, code in (("a", 2.0, "N17"), ("b", 2.0, "I10"), ("c", 1.0, "N17"), ("d", 1.0, "I10")):
        rows += admitted(hadm=hadm) + labs((0, 1.0), (5, rise), hadm=hadm)
        rows.append(("p", hadm, "diagnoses_icd", hours(9), None, None, "10", code))
    matrix, scores = phenotype.validate_detector(frame(EVENTS, rows), frame(RATE, []))
    assert rows_of(matrix) == [("negative", 1, 1), ("positive", 1, 1)]
    assert dict(rows_of(scores))["accuracy"] == 0.5
