"""Cutting tokenised timelines into overlapping sequences, placing labels on them, packing them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions.expressions import days_between, floor_div, next_power_of_two, z_score
from tidemark.operators.align import asof_join
from tidemark.operators.blocks import heavy_splits, join_per_key, number_rows, running
from tidemark.session import cut_lineage, small_side


def birth_times(events: DataFrame) -> DataFrame:
    """``subject_id, birth``: the earliest birth event of each subject."""
    return (
        events.filter(F.col("code") == fixed.BIRTH_CODE)
        .groupBy("subject_id")
        .agg(F.min("time").alias("birth"))
    )


def until_last_landmark(events: DataFrame, labels: DataFrame, order: tuple[str, ...] = ("time",)) -> DataFrame:
    """Events of labelled subjects at or before the subject's last landmark."""
    last = labels.groupBy("subject_id").agg(F.max("prediction_time").alias("_last"))
    splits = heavy_splits(events, ["subject_id"], order)
    return (
        join_per_key(events, last, ["subject_id"], splits)
        .filter(F.col("time") <= F.col("_last"))
        .select(*events.columns)
    )


def _chunk_count(n_events: Column, length: int, stride: int) -> Column:
    extra = floor_div(n_events - length + stride - 1, stride)
    return F.greatest(F.lit(0), extra) + 1


def chunk_timelines(
    events: DataFrame,
    births: DataFrame,
    *,
    length: int,
    stride: int,
    age_mean: float,
    age_std: float,
    ordinal: str,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Place tokenised events in sequences of at most ``length``, starting every ``stride``.

    A longer timeline is cut into overlapping chunks, so events in an overlap appear twice.
    Sequence ids are dense from zero in order of (subject, chunk). Subjects without a birth are
    left out. Ages are in days, counted in whole minutes.

    Args:
        events: ``subject_id, time, index`` and the ``ordinal`` column.
        births: ``subject_id, birth``.
        length: positions of the longest sequence.
        stride: distance between starts of consecutive sequences.
        age_mean: mean age in days, for ``normed_age``.
        age_std: standard deviation of the age in days.
        ordinal: column that orders events sharing a timestamp; unique within the subject.
        rows_per_block: see ``running``.
    """
    if not 0 < stride <= length:
        raise ValueError(f"sequences of {length} cannot start every {stride} positions; some events would be in none")
    if not age_std > 0:
        raise ValueError(f"ages cannot be scaled by a deviation of {age_std}")

    order = ["time", ordinal]
    splits = heavy_splits(events, ["subject_id"], order, rows_per_block)
    # One small row per subject carries everything the events need to know about it, including
    # the number of sequences of all subjects before it.
    subjects = (
        events.groupBy("subject_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(births, "subject_id")
        .withColumn("_chunks", _chunk_count(F.col("_n"), length, stride))
    )
    subjects = running(
        cut_lineage(subjects), [], ["subject_id"], {"_base": ("sum", F.col("_chunks"))},
        exclusive=True, rows_per_block=rows_per_block,
    ).select("subject_id", "birth", "_chunks", F.coalesce("_base", F.lit(0)).alias("_base"))

    positioned = number_rows(
        join_per_key(
            events.select("subject_id", "time", "index", ordinal), subjects, ["subject_id"], splits
        ),
        ["subject_id"], order, "subject_position", splits=splits,
    )
    place = F.col("subject_position")
    first = F.greatest(F.lit(0), floor_div(place - length, stride) + 1)
    last = F.least(floor_div(place, stride), F.col("_chunks") - 1)
    age = days_between("birth", "time")
    return positioned.withColumn("_chunk", F.explode(F.sequence(first, last))).select(
        "subject_id",
        (F.col("_base") + F.col("_chunk")).alias("sequence_id"),
        (place - F.col("_chunk") * stride).alias("position"),
        "subject_position",
        F.col("index").cast("bigint").alias("index"),
        "time",
        age.cast("float").alias("age"),
        z_score(age, age_mean, age_std).cast("float").alias("normed_age"),
    )


def place_landmarks(
    sequences: DataFrame, labels: DataFrame, rows_per_block: int | None = None
) -> DataFrame:
    """Put each landmark on the last event at or before it.

    Of an event's places the one deepest into its sequence is taken, which has most history in
    front. Landmarks before the first event are dropped; landmarks sharing a place are kept.
    """
    placed = asof_join(
        labels.select("subject_id", "prediction_time", "boolean_value"),
        sequences,
        on="prediction_time",
        right_on="time",
        by=["subject_id"],
        take=["sequence_id", "position"],
        tie=["subject_position", "position"],
        rows_per_block=rows_per_block,
    )
    return placed.filter(F.col("position").isNotNull()).select(
        "subject_id", "sequence_id", "position", "prediction_time", "boolean_value"
    )


class PackedBatches(NamedTuple):
    """Batches of padded sequences.

    sequences: per sequence ``batch, row, sequence_id, seq_len`` and arrays of length seq_len:
        ``ages, normed_ages, valid_tokens, segment_ids``.
    pairs: ``batch, token, flat``, flat being row * seq_len + position.
    labels: ``batch, flat, label``.
    """

    sequences: DataFrame
    pairs: DataFrame | None
    labels: DataFrame


def pack_batches(
    sequences: DataFrame,
    placed: DataFrame,
    expansion: DataFrame | None,
    batch_size: int,
    check: bool = True,
) -> PackedBatches:
    """Pack sequences, ``batch_size`` to a batch in order of id, padded to a power of two.

    Sequences are gathered once, by batch, and written; rows, pairs and the places of labels are all read off
    that. Without an ``expansion`` there are no pairs. ``check`` refuses empty input and labels of other sequences.
    """
    held = cut_lineage(_gathered(sequences, batch_size))
    shape = held.select("sequence_id", "batch", "row", "seq_len")
    if check:
        _require_packable(shape, placed)
    padding = F.col("seq_len").cast("int") - F.size("cells")

    def padded(values: Column, filler: Column) -> Column:
        return F.concat(values, F.array_repeat(filler, padding))

    zero = F.lit(0.0).cast("float")
    grids = held.select(
        "batch",
        "row",
        "sequence_id",
        "seq_len",
        padded(F.col("cells.age"), zero).alias("ages"),
        padded(F.col("cells.normed_age"), zero).alias("normed_ages"),
        padded(F.transform("cells", lambda _: F.lit(True)), F.lit(False)).alias("valid_tokens"),
        F.array_repeat(F.lit(0).cast("bigint"), F.col("seq_len").cast("int")).alias("segment_ids"),
    )
    flat = (F.col("row") * F.col("seq_len") + F.col("position")).alias("flat")
    pairs = None if expansion is None else (
        held.select("batch", "row", "seq_len", F.inline("cells"))
        .select("batch", "index", flat)
        .join(small_side(expansion), "index")
        .select("batch", "token", "flat")
    )
    labels = placed.join(shape, "sequence_id").select(
        "batch", flat, F.col("boolean_value").cast("float").alias("label")
    )
    return PackedBatches(grids, pairs, labels)


def _gathered(sequences: DataFrame, batch_size: int) -> DataFrame:
    """One row per sequence: ``batch, sequence_id, row, seq_len`` and its ``cells`` in order.

    One shuffle, by batch, serves the grouping and both windows. A group holds no more than a sequence's length,
    a window no more than a batch.
    """
    in_batch = Window.partitionBy("batch")
    return (
        sequences.select("sequence_id", "position", "age", "normed_age", "index")
        .withColumn("batch", floor_div(F.col("sequence_id"), batch_size))
        .repartition("batch")
        .groupBy("batch", "sequence_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("position", "age", "normed_age", "index"))).alias("cells"),
            F.max("position").alias("last"),
        )
        .select(
            "batch",
            "sequence_id",
            (F.row_number().over(in_batch.orderBy("sequence_id")) - 1).cast("bigint").alias("row"),
            next_power_of_two(F.max("last").over(in_batch) + 1).cast("bigint").alias("seq_len"),
            "cells",
        )
    )


def _require_packable(shape: DataFrame, placed: DataFrame) -> None:
    if shape.isEmpty():
        raise ValueError("there is no sequence to pack")
    foreign = placed.join(shape, "sequence_id", "left_anti")
    sample = [r[0] for r in foreign.select("sequence_id").distinct().limit(5).collect()]
    if sample:
        raise ValueError(f"labels name sequences that are not there, such as {sample}")
