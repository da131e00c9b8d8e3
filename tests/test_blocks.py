"""Running, as-of and trailing results must not depend on how a heavy key is cut."""

import datetime as dt
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import hours, rows_of
from tidemark.operators.align import asof_backfill, asof_join
from tidemark.operators.blocks import cut_tree, heavy_splits, number_rows, place_in_blocks, running, split_points
from tidemark.operators.rolling import trailing

SCHEMA = "k string, t timestamp_ntz, id bigint, v double"


def skewed_rows(n=400, seed=1):
    """One key holds most rows; some share a timestamp; one key is null; some values are null."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        at = hours(rng.randrange(0, 24 * 20 * 4) / 4)
        rows.append((key, at, i, None if rng.random() < 0.1 else float(rng.randrange(1, 50))))
    return rows


@pytest.fixture
def skewed(frame):
    return frame(SCHEMA, skewed_rows())


def test_heavy_key_is_cut_and_small_keys_are_not(skewed):
    cuts = [r["k"] for r in split_points(skewed, ["k"], ["t", "id"], 60).collect()]
    assert set(cuts) == {"hot"} and len(cuts) >= 2
    assert split_points(skewed, ["k"], ["t", "id"]).count() == 0
    assert heavy_splits(skewed, ["k"], ["t", "id"]) is None


@pytest.mark.parametrize("n", [5, 150, 64 * 64 + 70])
def test_blocks_count_the_cuts_at_or_below(frame, n):
    """One to three levels of cuts, with rows before the first and after the last."""
    cut_at = list(range(10, 10 + 2 * n, 2))
    cuts = frame("k string, _cut struct<id:bigint>, _rank bigint", [("hot", (c,), i + 1) for i, c in enumerate(cut_at)])
    splits = cut_tree(cuts, ["k"])
    assert len(splits.levels) == 1 + (n > 64) + (n > 64 * 64)
    ids = range(0, 2 * n + 30, 1 if n < 1000 else 7)
    rows = frame("k string, id bigint", [("hot", i) for i in ids] + [("cold", 50), (None, 50)])
    got = place_in_blocks(rows, splits, ["k"], ["id"], begins="first")
    known = set(cut_at)
    want = [("hot", i, sum(c <= i for c in cut_at), i in known) for i in ids] + [("cold", 50, 0, False), (None, 50, 0, False)]
    assert rows_of(got, "k", "id", "_block", "first") == rows_of_list(want)
    assert place_in_blocks(rows, splits, ["k"], ["id"], "inner").count() == len(ids)


def test_blocks_are_even(spark):
    """Nine rows in ten on one key, and a key with a crowd at few moments."""
    rows = spark.range(100_000, numPartitions=6).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"),
        F.xxhash64("id").alias("at"),
    )
    splits = heavy_splits(rows, ["k"], ["at"], 1000)
    sizes = [r["count"] for r in place_in_blocks(rows, splits, ["k"], ["at"], "inner").groupBy("_block").count().collect()]
    assert sum(sizes) == 90_000 and len(sizes) > 60 and max(sizes) <= 3000
    crowd = spark.range(20_000, numPartitions=6).select(F.lit("a").alias("k"), (F.col("id") % 50).alias("at"))
    assert heavy_splits(crowd, ["k"], ["at"], 5_000) is not None


@pytest.mark.parametrize("rows_per_block", [3, 25, 10**6])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_equals_plain_window(skewed, rows_per_block, reverse):
    aggs = {k: (k, F.col("v")) for k in ("min", "max", "sum", "count", "last")}
    got = running(
        skewed, ["k"], ["t", "id"], aggs, reverse=reverse, group_size="n",
        rows_per_block=rows_per_block,
    )
    order = [F.desc("t"), F.desc("id")] if reverse else ["t", "id"]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select(
        "*", F.min("v").over(w).alias("min"), F.max("v").over(w).alias("max"),
        F.sum("v").over(w).alias("sum"), F.count("v").over(w).alias("count"),
        F.last("v", True).over(w).alias("last"),
        F.count(F.lit(1)).over(Window.partitionBy("k")).alias("n"),
    )
    names = ["id", "min", "max", "sum", "count", "last", "n"]
    assert rows_of(got, *names) == rows_of(want, *names)


@pytest.mark.parametrize("rows_per_block", [5, 10**6])
def test_running_exclusive_and_global(skewed, rows_per_block):
    got = running(
        skewed, [], ["t", "id"], {"before": ("count", F.col("id"))}, exclusive=True,
        rows_per_block=rows_per_block,
    )
    assert [r[0] for r in got.orderBy("t", "id").select("before").collect()] == list(range(400))


@pytest.mark.parametrize("rows_per_block", [4, 10**6])
def test_number_rows(skewed, rows_per_block):
    got = number_rows(skewed, ["k"], ["t", "id"], "p", rows_per_block=rows_per_block)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.withColumn("p", F.row_number().over(w) - 1)
    assert rows_of(got, "id", "p") == rows_of(want, "id", "p")


@pytest.mark.parametrize("closed,low", [("right", 1), ("both", 0)])
@pytest.mark.parametrize("rows_per_block", [6, 10**6])
def test_trailing_equals_brute_force(skewed, closed, low, rows_per_block):
    got = trailing(
        skewed, ["k"], "t", "48h",
        {"lo": ("min", F.col("v")), "s": ("sum", F.col("v")), "n": ("count", F.lit(1))},
        closed=closed, rows_per_block=rows_per_block,
    )
    rows = skewed_rows()
    want = []
    for k, t, i, _ in rows:
        edge = t - dt.timedelta(hours=48)
        inside = [r for r in rows if r[0] == k and r[1] <= t
                  and (r[1] > edge if closed == "right" else r[1] >= edge)]
        values = [r[3] for r in inside if r[3] is not None]
        want.append((i, min(values, default=None), sum(values) if values else None, len(inside)))
    assert sorted(rows_of(got, "id", "lo", "s", "n")) == sorted(want)


def test_trailing_sums_have_the_same_bits(frame):
    """Random doubles of very different sizes, however they are cut; close to the exact sums."""
    rng = random.Random(9)
    rows = [(rng.choice("ab"), hours(rng.randrange(400) / 8), i, rng.uniform(-1, 1) * 10.0 ** rng.randrange(-6, 6)) for i in range(500)]
    df = frame(SCHEMA, rows)
    ways = []
    for size in (2, 7, None):
        got = trailing(df, ["k"], "t", "6h", {"s": ("sum", F.col("v"))}, closed="both", rows_per_block=size)
        ways.append(rows_of(got, "id", "s"))
    assert ways[0] == ways[1] == ways[2]
    for (_, got), (k, t, *_) in zip(ways[0], rows):
        exact = sum(Fraction(v) for kk, tt, _, v in rows if kk == k and t - dt.timedelta(hours=6) <= tt <= t)
        assert abs(Fraction(got) - exact) <= Fraction(1, 10**9)


def test_trailing_sums_of_odd_values(frame):
    """Infinities and not-a-numbers stay within their windows; tiny and huge values; nulls; clashing names."""
    inf = float("inf")
    rows = [("a", hours(0), 1, 5e-324), ("a", hours(1), 2, inf), ("a", hours(5), 3, 2.5), ("a", hours(6), 4, None),
            ("b", hours(0), 5, inf), ("b", hours(1), 6, -inf), ("c", hours(0), 7, None), ("d", hours(0), 8, 1e300), ("d", hours(1), 9, 1e300)]
    for size in (1, None):
        got = rows_of(trailing(frame(SCHEMA, rows), ["k"], "t", "2h", {"v": ("sum", F.col("v"))}, rows_per_block=size), "id", "v")
        assert [r for r in got if r[0] not in (6,)] == [
            (1, 5e-324), (2, inf), (3, 2.5), (4, 2.5), (5, inf), (7, None), (8, 1e300), (9, 2e300)]
        assert math.isnan(dict(got)[6])
    assert rows_of(trailing(frame(SCHEMA, []), ["k"], "t", "2h", {"s": ("sum", F.col("v"))})) == []


@pytest.mark.parametrize("rows_per_block", [5, 10**6])
def test_asof_equals_brute_force(frame, rows_per_block):
    right_rows = skewed_rows(150, seed=3)
    left_rows = skewed_rows(250, seed=4)
    left, right = frame(SCHEMA, left_rows), frame(SCHEMA, right_rows).withColumnsRenamed(
        {"v": "w", "id": "rid"})
    got = asof_join(left, right, on="t", by=["k"], take=["w", "rid"], tie=["rid"],
                    rows_per_block=rows_per_block)
    want = []
    for k, t, i, _ in left_rows:
        match = max(((r[1], r[2], r[3]) for r in right_rows
                     if k is not None and r[0] == k and r[1] <= t), default=None)
        want.append((i, match[2] if match else None, match[1] if match else None))
    assert rows_of(got, "id", "w", "rid") == rows_of_list(want)


@pytest.mark.parametrize("rows_per_block", [5, 10**6])
def test_asof_then_backfill(frame, rows_per_block):
    right_rows = [(k, t, i, v) for k, t, i, v in skewed_rows(60, seed=5) if t > hours(200)]
    left_rows = skewed_rows(200, seed=6)
    left = frame(SCHEMA, left_rows)
    right = frame(SCHEMA, right_rows).select("k", "t", F.col("id").alias("rid"), F.col("v").alias("w"))
    got = asof_backfill(left, right, on="t", by=["k"], value="w", tie=["rid"], left_tie=["id"],
                        rows_per_block=rows_per_block)
    matched = {}
    for k, t, i, _ in left_rows:
        m = max(((r[1], r[2], r[3]) for r in right_rows
                 if k is not None and r[0] == k and r[1] <= t), default=None)
        matched[i] = m[2] if m else None
    want = []
    for k, t, i, _ in left_rows:
        later = sorted((r[1], r[2]) for r in left_rows if r[0] == k and (r[1], r[2]) >= (t, i))
        want.append((i, next((matched[j] for _, j in later if matched[j] is not None), None)))
    assert rows_of(got, "id", "w") == rows_of_list(want)


def test_equal_left_rows_are_spread(spark):
    """Most left rows are one row repeated; each finds its match, and none of the blocks holds them all."""
    left = spark.range(6000, numPartitions=4).select(F.lit("a").alias("k"), F.lit(5).alias("t"), F.lit("x").alias("v"))
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 4, 20.0), ("a", 4, 20.0), ("a", 6, 30.0)], "k string, t int, w double")
    for size in (300, None):
        got = asof_join(left, right, on="t", by=["k"], take=["w"], rows_per_block=size)
        assert rows_of(got.groupBy("k", "t", "v", "w").count()) == [("a", 5, "x", 20.0, 6000)]
        if size:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            try:
                per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
            finally:
                spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
            assert len(per_task) == 3 and max(per_task) < 4000


def rows_of_list(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)) if v is None else v) for v in r))


def test_asof_match_with_null_value_wins(frame):
    left = frame("k string, t timestamp_ntz", [("a", hours(5))])
    right = frame("k string, t timestamp_ntz, w double", [("a", hours(1), 7.0), ("a", hours(2), None)])
    assert rows_of(asof_join(left, right, on="t", by=["k"], take=["w"]), "w") == [(None,)]
