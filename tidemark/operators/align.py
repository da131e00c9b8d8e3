"""As-of joins: match each row to the latest earlier row of another frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import col, no_nulls
from tidemark.operators.blocks import heavy_splits, running
from tidemark.session import cut_lineage

_SEED = 11


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    on: str,
    by: Sequence[str],
    take: Sequence[str],
    right_on: str | None = None,
    tie: Sequence[str] = (),
    rows_per_block: int | None = None,
    may_be_heavy: bool = True,
) -> DataFrame:
    """Add to each left row the ``take`` columns of the last right row at or before it.

    Both frames go through one shuffle as a single tagged stream; a running "last right row"
    does the matching. A matched row wins even if its values are null. Among right rows at one
    time the largest ``tie`` wins, then the largest ``take`` values. Left rows without a match
    keep nulls. ``may_be_heavy=False`` is the caller's word that no key is too large for one
    task, and spares the look.
    """
    right_on = right_on or on
    keys = [f"_key_{i}" for i in range(len(by))]
    named_keys = [col(name).alias(key) for name, key in zip(by, keys)]

    probes = left.select(
        *named_keys,
        col(on).alias("_at"),
        F.lit(1).alias("_side"),
        # Lets a crowd of left rows at one moment be cut into blocks, also if they are equal throughout. What a
        # left row finds does not depend on its place among them, so any number serves.
        F.rand(_SEED).alias("_spread"),
        F.struct(*[col(c) for c in left.columns]).alias("_left"),
    )
    taken = F.struct(*[col(c) for c in take])
    candidates = right.filter(no_nulls([right_on, *by])).select(
        *named_keys,
        col(right_on).alias("_at"),
        F.lit(0).alias("_side"),
        # The constant keeps the struct usable as a sort key when there is no tie column.
        F.struct(F.lit(0).alias("_none"), *[col(t) for t in tie], taken.alias("_taken")).alias("_tie"),
        taken.alias("_right"),
    )
    order = ["_at", "_side", "_tie", "_spread"]
    stream = candidates.unionByName(probes, allowMissingColumns=True)
    splits = heavy_splits(stream, keys, order, rows_per_block) if may_be_heavy else None
    if splits is not None:
        # With a heavy key about, copies of one right row must not pile up in one block.
        stream = candidates.distinct().unionByName(probes, allowMissingColumns=True)
    matched = running(stream, keys, order, {"_match": ("last", F.col("_right"))}, splits=splits)
    return matched.filter(F.col("_side") == 1).select(
        *[F.col("_left").getField(c).alias(c) for c in left.columns],
        *[F.col("_match").getField(c).alias(c) for c in take],
    )


def backfill(
    df: DataFrame,
    value: str,
    *,
    by: Sequence[str],
    order: Sequence[str],
    rows_per_block: int | None = None,
    may_be_heavy: bool = True,
) -> DataFrame:
    """Fill each null of ``value`` from the next row of the group that has one."""
    splits = heavy_splits(df, by, order, rows_per_block) if may_be_heavy else None
    filled = running(df, by, order, {value: ("last", col(value))}, reverse=True, splits=splits)
    return filled.select(*[col(c) for c in df.columns])


def asof_backfill(
    left: DataFrame,
    right: DataFrame,
    *,
    on: str,
    by: Sequence[str],
    value: str,
    tie: Sequence[str] = (),
    left_tie: Sequence[str] = (),
    rows_per_block: int | None = None,
    may_be_heavy: bool = True,
) -> DataFrame:
    """As-of join, then give rows before the first match the next matched value of the group."""
    options = {"rows_per_block": rows_per_block, "may_be_heavy": may_be_heavy}
    matched = asof_join(left, right, on=on, by=by, take=[value], tie=tie, **options)
    order = [on, *left_tie]
    # The join keeps the left rows, so the look at them serves; what is cut is read twice and written down.
    splits = heavy_splits(left, by, order, rows_per_block) if may_be_heavy else None
    if splits is not None:
        matched = cut_lineage(matched)
    filled = running(matched, by, order, {value: ("last", col(value))}, reverse=True, splits=splits)
    return filled.select(*[col(c) for c in matched.columns])
