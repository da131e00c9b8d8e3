"""Strata and folds."""

from hashlib import sha256
from struct import pack

import pytest

from tests.conftest import rows_of
from tidemark.operators import folds


def strata_of(frame, admissions, positives, subjects=(1, 2, 3)):
    got = folds.subject_strata(
        frame("subject_id bigint", [(s,) for s in subjects]),
        frame("subject_id bigint, visit_id bigint", admissions),
        frame("visit_id bigint", [(v,) for v in positives]))
    return {r["subject_id"]: r.asDict() for r in got.collect()}


def test_every_subject_is_kept(frame):
    got = strata_of(frame, [(1, 10)], [])
    assert {s: r["stratum"] for s, r in got.items()} == {1: "negative_1", 2: "negative_0", 3: "negative_0"}


def test_admissions_count_once_and_nulls_do_not(frame):
    got = strata_of(frame, [(1, 10), (1, 10), (1, None), (None, 11), (2, 20), (2, 21), (3, 30), (3, 31), (3, 32), (3, 33)], [])
    assert {s: (r["n_admissions"], r["admission_bucket"]) for s, r in got.items()} == {1: (1, "1"), 2: (2, "2-3"), 3: (4, "4+")}


def test_positive_admissions(frame):
    got = strata_of(frame, [(1, 10), (1, 11), (2, 20)], [10, 10, 99])
    assert (got[1]["n_positive_admissions"], got[1]["ever_positive"], got[1]["stratum"]) == (1, True, "positive_2-3")
    assert got[2]["stratum"] == "negative_1"


def test_repeated_subjects_are_refused(frame):
    with pytest.raises(ValueError):
        strata_of(frame, [], [], subjects=(1, 1))


def assigned(frame, ids, stratum="s", rows_per_block=None, **options):
    df = frame("subject_id bigint, stratum string", [(i, stratum) for i in ids])
    return dict(rows_of(folds.assign_folds(df, rows_per_block=rows_per_block, **options), "subject_id", "fold"))


def expected(ids, seed=42, bounds=(0.7, 0.7 + 0.15)):
    ranked = sorted(ids, key=lambda i: (sha256(pack(">q", seed) + pack(">q", i)).hexdigest()[:16], i))
    names = ("training", "validation", "testing")
    return {i: names[sum(place / len(ids) >= b for b in bounds)] for place, i in enumerate(ranked)}


@pytest.mark.parametrize("n,sizes", [(20, (14, 3, 3)), (10, (7, 2, 1)), (1, (1, 0, 0))])
@pytest.mark.parametrize("rows_per_block", [3, None])
def test_sizes_and_members(frame, n, sizes, rows_per_block):
    got = assigned(frame, range(n), rows_per_block=rows_per_block)
    counts = tuple(list(got.values()).count(f) for f in ("training", "validation", "testing"))
    assert counts == sizes
    assert got == expected(range(n))


def test_seed_matters_and_negative_ids_work(frame):
    ids = [-5, -1, 0, 3, 8, 11, 19, 200, 4000, 10**12]
    assert assigned(frame, ids, seed=7) == expected(ids, seed=7)


def test_strata_are_split_separately_and_names_come_from_the_fractions(frame):
    df = frame("subject_id bigint, stratum string", [(i, "a" if i < 10 else "b") for i in range(20)])
    got = rows_of(folds.assign_folds(df, {"x": 0.5, "y": 0.5}), "stratum", "fold")
    assert got == [("a", "x")] * 5 + [("a", "y")] * 5 + [("b", "x")] * 5 + [("b", "y")] * 5


@pytest.mark.parametrize("fractions", [{"a": 0.5, "b": 0.4}, {"a": 1.5, "b": -0.5}])
def test_bad_fractions_are_refused(frame, fractions):
    with pytest.raises(ValueError):
        assigned(frame, range(3), fractions=fractions)


def test_crosstab(frame):
    df = frame("stratum string, fold string", [("a", "training"), ("a", "training"), ("b", "testing")])
    assert rows_of(folds.fold_crosstab(df)) == [("a", 2, 0, 0), ("b", 0, 0, 1)]
