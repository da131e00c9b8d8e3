"""Numbering whole frames by their own columns."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import hours, rows_of
from tidemark.operators.ordinals import number_events, number_in_order

SCHEMA = "subject_id bigint, time timestamp_ntz, code string, value double, tags map<string,int>"


def made_up(n, seed=1):
    pick = random.Random(seed)
    codes = ["B", "A", None, "MEDS_BIRTH"]
    return [
        (pick.choice([1, 1, 1, 2, None]), pick.choice([None, hours(pick.randrange(5))]), pick.choice(codes), pick.choice([None, 1.5, -2.0]), None)
        for _ in range(n)
    ]


def by_hand(rows):
    nulls = lambda v: (v is not None, v if v is not None else 0)
    key = lambda r: (nulls(r[0]), nulls(r[1]), r[2] != "MEDS_BIRTH", (r[2] is not None, r[2] or ""), nulls(r[3]))
    return [(i, *r[:4]) for i, r in enumerate(sorted(rows, key=key))]


@pytest.mark.parametrize("n", [0, 1, 700])
def test_events_are_numbered_by_subject_time_birth_and_code(frame, n):
    """Ties and nulls in every column, many equal rows; twice the same numbers."""
    rows = made_up(n)
    for _ in range(2):
        got = number_events(frame(SCHEMA, rows))
        assert [tuple(r) for r in got.select("ordinal", "subject_id", "time", "code", "value").orderBy("ordinal").collect()] == by_hand(rows)


def test_a_crowd_of_equal_rows_is_spread(spark):
    rows = spark.range(20_000, numPartitions=8).select(F.lit(7).alias("a"), (F.col("id") % 10 == 0).cast("int").alias("b"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = number_in_order(rows.repartition(8), ["a"], "n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (0, 19_999, 20_000)
    assert rows_of(got.groupBy("b").agg(F.min("n"), F.max("n"))) == [(0, 0, 17_999), (1, 18_000, 19_999)]
    per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 3 and max(per_task) < 10_000
