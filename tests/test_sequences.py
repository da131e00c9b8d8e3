"""Tokens, sequences, labels on them, packed batches, embedding sums."""

import datetime as dt

import pytest

from tests.conftest import rows_of
from tidemark.operators import sequences, tokens
from tidemark.operators.concepts import Vocabulary

DAY0 = dt.datetime(2100, 1, 1)
EDGE = 1.7976931348623157e308


def day(n):
    return DAY0 + dt.timedelta(days=n)


@pytest.fixture
def vocabulary(frame):
    return Vocabulary(
        tokens=frame("code string, weight double", []),
        codes=frame("code string, index bigint", [("A", 0), ("P", 1), ("T", 2), ("B", 9)]),
        bins=frame("code string, val_start double, val_end double, index bigint",
                   [("A", -EDGE, 1.0, 3), ("A", 1.0, 5.0, 4), ("A", 5.0, EDGE, 5), ("C", 0.0, 1.0, 6)]),
        texts=frame("code string, text string, index bigint", [("T", "yes", 7), ("A", "yes", 8)]))


@pytest.mark.parametrize("code,number,text,want", [
    ("A", 0.0, None, 3), ("A", 1.0, None, 4), ("A", 4.999, None, 4), ("A", 5.0, None, 5), ("A", 1e30, None, 5),
    ("A", None, None, 0),            # no value: the bare code
    ("A", 2.0, "yes", 4),            # the bin wins over the text
    ("A", None, "yes", 8), ("T", None, "yes", 7), ("T", None, "no", 2), ("T", 3.0, "yes", 7),
    ("B", 3.0, None, 9),             # a value on a code without bins
    ("C", 9.0, None, 6),             # past the last bin that was kept
    ("C", -1.0, None, None), ("C", None, None, None), ("Z", 1.0, "yes", None), (None, 1.0, None, None),
])
def test_leaf_tokens(frame, vocabulary, code, number, text, want):
    events = frame("subject_id bigint, code string, numeric_value float, text_value string", [(1, code, number, text)])
    got = tokens.leaf_tokens(events, vocabulary)
    assert got.columns == ["subject_id", "code", "numeric_value", "text_value", "index"]
    assert rows_of(got, "index") == ([] if want is None else [(want,)])


def test_ancestor_expansion_and_fanout(frame, vocabulary):
    closure = frame("code string, ancestor string",
                    [("A", "A"), ("A", "P"), ("A", "OUT"), ("P", "P"), ("T", "P"), ("T", "A"), ("Z", "A")])
    expansion = tokens.ancestor_expansion(vocabulary, closure)
    assert rows_of(expansion) == [(0, 0), (0, 1), (1, 1), (2, 0), (2, 1), (2, 2),
                                  *[(i, i) for i in (3, 4, 5, 6, 7, 8)], (9, 9)]
    events = frame("index bigint, position bigint", [(0, 10), (3, 11), (77, 12)])
    assert rows_of(tokens.expand_tokens(events, expansion)) == [(0, 10), (1, 10), (3, 11)]


def test_sum_embeddings(frame):
    pairs = frame("token bigint, position bigint", [(0, 0), (1, 0), (1, 2), (1, 2)])
    table = frame("token bigint, embedding array<float>", [(0, [1.0, 2.0]), (1, [10.0, 20.0]), (2, [5.0, 5.0])])
    positions = frame("position bigint", [(0,), (1,), (2,)])
    assert rows_of(tokens.sum_embeddings(pairs, table, 2, positions=positions)) == [
        (0, [11.0, 22.0]), (1, [0.0, 0.0]), (2, [20.0, 40.0])]


def test_sums_of_wide_embeddings(frame):
    pairs = frame("token bigint, position bigint", [(0, 0), (1, 0), (1, 1)])
    rows = [(t, [float(t * 1000 + i) for i in range(150)]) for t in (0, 1)]
    got = rows_of(tokens.sum_embeddings(pairs, frame("token bigint, embedding array<double>", rows), 150))
    assert got == [(0, [1000.0 + 2 * i for i in range(150)]), (1, [1000.0 + i for i in range(150)])]


@pytest.mark.parametrize("table", [[(1, [1.0, 2.0])], [(0, [1.0]), (1, [1.0, 2.0])], [(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0])], [(0, None)]])
def test_unknown_tokens_and_wrong_lengths_are_refused(frame, table):
    pairs = frame("token bigint, position bigint", [(0, 0), (1, 0)])
    with pytest.raises(Exception, match="no vector of 2 numbers for token 0|no vector of 2 numbers for token 1"):
        tokens.sum_embeddings(pairs, frame("token bigint, embedding array<double>", table), 2).collect()


EVENTS = "subject_id bigint, time timestamp_ntz, index bigint, ordinal bigint"


def built(frame, n=4, subjects=(1,), length=8, stride=None, births=None, rows_per_block=None, **options):
    rows = [(s, day(i), 100 * s + i, i) for s in subjects for i in range(n)]
    born = births or [(s, DAY0 - dt.timedelta(days=10)) for s in subjects]
    return sequences.chunk_timelines(
        frame(EVENTS, rows), frame("subject_id bigint, birth timestamp_ntz", born), length=length,
        stride=stride or length, **{"age_mean": 0.0, "age_std": 1.0, "ordinal": "ordinal", **options},
        rows_per_block=rows_per_block)


def chunks(df):
    found = {}
    for r in df.orderBy("sequence_id", "position").collect():
        found.setdefault(r["sequence_id"], []).append(r["subject_position"])
        assert r["position"] == len(found[r["sequence_id"]]) - 1
    return [found[i] for i in range(len(found))]


def expected_chunks(n, length, stride):
    starts = [0]
    while starts[-1] + length < n:
        starts.append(starts[-1] + stride)
    return [list(range(s, min(s + length, n))) for s in starts]


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 7, 8])
def test_chunk_boundaries(frame, n):
    assert chunks(built(frame, n, length=4, stride=2)) == expected_chunks(n, 4, 2)


@pytest.mark.parametrize("length,stride", [(4, 4), (5, 3), (1, 1), (10, 1)])
@pytest.mark.parametrize("rows_per_block", [3, None])
def test_other_lengths_and_blocks(frame, length, stride, rows_per_block):
    got = chunks(built(frame, 13, subjects=(1, 2, 5), length=length, stride=stride, rows_per_block=rows_per_block))
    assert got == expected_chunks(13, length, stride) * 3


def test_ids_follow_subject_and_chunk(frame):
    got = built(frame, 6, subjects=(7, 3), length=4, stride=2)
    assert sorted({(r["subject_id"], r["sequence_id"]) for r in got.collect()}) == [(3, 0), (3, 1), (7, 2), (7, 3)]


def test_subjects_without_birth_are_left_out_and_ids_stay_dense(frame):
    got = built(frame, 2, subjects=(1, 2, 3), births=[(1, DAY0), (3, DAY0), (9, DAY0)])
    assert sorted({(r["subject_id"], r["sequence_id"]) for r in got.collect()}) == [(1, 0), (3, 1)]


def test_ordinal_breaks_ties(frame):
    rows = [(1, DAY0, i * 7 % 5, i) for i in range(5)]
    got = sequences.chunk_timelines(
        frame(EVENTS, rows), frame("subject_id bigint, birth timestamp_ntz", [(1, DAY0)]),
        length=8, stride=8, age_mean=0, age_std=1, ordinal="ordinal")
    assert [r["index"] for r in got.orderBy("position").collect()] == [0, 2, 4, 1, 3]


def test_ages_count_whole_minutes(frame):
    rows = [(1, DAY0 + dt.timedelta(minutes=90, seconds=59), 5, 0)]
    got = sequences.chunk_timelines(
        frame(EVENTS, rows), frame("subject_id bigint, birth timestamp_ntz", [(1, DAY0)]),
        length=8, stride=8, age_mean=1.0, age_std=2.0, ordinal="ordinal").first()
    assert got["age"] == pytest.approx(0.0625)
    assert got["normed_age"] == pytest.approx((0.0625 - 1) / 2)


@pytest.mark.parametrize("options", [
    {"length": 0, "stride": 1}, {"length": 4, "stride": 5}, {"length": 4, "stride": -1}, {"age_std": 0.0}])
def test_bad_shapes_are_refused(frame, options):
    with pytest.raises(ValueError):
        built(frame, **options)


def test_births_take_the_earliest(frame):
    events = frame("subject_id bigint, time timestamp_ntz, code string", [
        (1, day(3), "MEDS_BIRTH"), (1, day(1), "MEDS_BIRTH"), (2, day(0), "X")])
    assert rows_of(sequences.birth_times(events)) == [(1, day(1))]


LABELS = "subject_id bigint, prediction_time timestamp_ntz, boolean_value boolean"


def test_events_after_the_last_landmark_go(frame):
    events = frame("subject_id bigint, time timestamp_ntz, code string", [
        (1, day(0), "a"), (1, day(2), "b"), (1, day(3), "c"), (2, day(0), "d"), (1, None, "e")])
    labels = frame(LABELS, [(1, day(1), True), (1, day(2), False), (3, day(9), True)])
    got = sequences.until_last_landmark(events, labels)
    assert got.columns == events.columns
    assert rows_of(got, "code") == [("a",), ("b",)]


def placed(frame, cells, *labels, **options):
    rows = [(s, day(at), flag) for s, at, flag in labels]
    got = sequences.place_landmarks(cells, frame(LABELS, rows), **options)
    assert got.columns == ["subject_id", "sequence_id", "position", "prediction_time", "boolean_value"]
    return rows_of(got, "sequence_id", "position", "boolean_value")


@pytest.mark.parametrize("at,want", [(2.0, [(0, 2, True)]), (2.5, [(0, 2, True)]), (9.0, [(0, 3, True)]), (-1.0, [])])
def test_landmark_on_between_after_and_before_events(frame, at, want):
    assert placed(frame, built(frame), (1, at, True)) == want


@pytest.mark.parametrize("n,at,want", [(6, 2.0, (0, 2, True)), (7, 6.0, (2, 2, True)), (6, 5.0, (1, 3, True))])
@pytest.mark.parametrize("rows_per_block", [2, None])
def test_the_place_with_most_history_wins(frame, n, at, want, rows_per_block):
    cells = built(frame, n, length=4, stride=2)
    assert placed(frame, cells, (1, at, True), rows_per_block=rows_per_block) == [want]


def test_landmarks_sharing_a_place_are_kept(frame):
    assert placed(frame, built(frame), (1, 2.1, True), (1, 2.6, False), (1, 2.6, False)) == [
        (0, 2, False), (0, 2, False), (0, 2, True)]


def test_landmarks_stay_with_their_subject(frame):
    cells = built(frame, subjects=(1, 2))
    assert placed(frame, cells, (2, 2.5, True), (3, 2.5, True)) == [(1, 2, True)]


def test_packing(frame):
    cells = built(frame, 3, subjects=(1, 2, 3), length=2, stride=2)
    labels = frame("subject_id bigint, sequence_id bigint, position bigint, prediction_time timestamp_ntz, boolean_value boolean",
                   [(1, 0, 1, day(1), True), (2, 3, 0, day(2), False)])
    expansion = frame("index bigint, token bigint", [(100, 100), (100, 5), (202, 202)])
    packed = sequences.pack_batches(cells, labels, expansion, batch_size=4)
    grids = rows_of(packed.sequences, "batch", "row", "sequence_id", "seq_len", "ages", "valid_tokens", "segment_ids")
    assert grids == [
        (0, 0, 0, 2, [10.0, 11.0], [True, True], [0, 0]), (0, 1, 1, 2, [12.0, 0.0], [True, False], [0, 0]),
        (0, 2, 2, 2, [10.0, 11.0], [True, True], [0, 0]), (0, 3, 3, 2, [12.0, 0.0], [True, False], [0, 0]),
        (1, 0, 4, 2, [10.0, 11.0], [True, True], [0, 0]), (1, 1, 5, 2, [12.0, 0.0], [True, False], [0, 0])]
    assert rows_of(packed.pairs) == [(0, 5, 0), (0, 100, 0), (0, 202, 6)]
    assert rows_of(packed.labels) == [(0, 1, 1.0), (0, 6, 0.0)]


def test_packing_gathers_sequences_in_one_shuffle(frame):
    """Ids with gaps, batches of uneven length; the plan groups and ranks by the one partitioning by batch."""
    rows = [(i, p, float(p), -float(p), 7) for i, n in ((0, 3), (2, 1), (9, 5), (11, 9)) for p in range(n)]
    cells = frame("sequence_id bigint, position bigint, age float, normed_age float, index bigint", rows).repartition(5)
    gathered = sequences._gathered(cells, 4)
    got = rows_of(gathered, "batch", "row", "sequence_id", "seq_len")
    assert got == [(0, 0, 0, 4), (0, 1, 2, 4), (2, 0, 9, 16), (2, 1, 11, 16)]
    assert {r.sequence_id: [c.position for c in r.cells] for r in gathered.collect()} == {0: [0, 1, 2], 2: [0], 9: list(range(5)), 11: list(range(9))}
    plan = gathered._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(batch") == 1


def test_packing_pads_to_a_power_of_two(frame):
    cells = built(frame, 5)
    none = frame("sequence_id bigint, position bigint, boolean_value boolean", [])
    row = sequences.pack_batches(cells, none, frame("index bigint, token bigint", []), 4).sequences.first()
    assert (row["seq_len"], len(row["ages"]), row["valid_tokens"]) == (8, 8, [True] * 5 + [False] * 3)


def test_packing_refuses_nothing_and_foreign_labels(frame):
    cells = built(frame)
    labels = frame("sequence_id bigint, position bigint, boolean_value boolean", [(9, 0, True)])
    expansion = frame("index bigint, token bigint", [])
    with pytest.raises(ValueError):
        sequences.pack_batches(cells.limit(0), labels.limit(0), expansion, 4)
    with pytest.raises(ValueError, match="9"):
        sequences.pack_batches(cells, labels, expansion, 4)
