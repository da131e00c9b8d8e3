"""Splitting subjects into folds, evenly within strata and the same way every time."""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions.expressions import count_band, stable_hash
from tidemark.operators.blocks import number_rows


def subject_universe(events: DataFrame) -> DataFrame:
    """Every subject of the unfiltered events, also those without an admission."""
    return events.select("subject_id").distinct()


def subject_strata(subjects: DataFrame, admissions: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Stratum per subject: ever diagnosed, crossed with the number of admissions in bands.

    Args:
        subjects: one row per subject; all of them are kept.
        admissions: events with ``subject_id`` and ``visit_id``.
        diagnoses: rows with the ``visit_id`` of diagnosed admissions.
    """
    repeated = subjects.groupBy("subject_id").count().filter("count > 1")
    if not repeated.isEmpty():
        raise ValueError(f"{repeated.count()} subjects are listed more than once")

    visits = (
        admissions.filter(F.col("subject_id").isNotNull() & F.col("visit_id").isNotNull())
        .select("subject_id", "visit_id")
        .distinct()
    )
    positive = diagnoses.select("visit_id").distinct().withColumn("_positive", F.lit(1))
    per_subject = (
        visits.join(positive, "visit_id", "left")
        .groupBy("subject_id")
        .agg(
            F.count(F.lit(1)).alias("n_admissions"),
            F.count("_positive").alias("n_positive_admissions"),
        )
    )
    none = F.lit(0).cast("bigint")
    return (
        subjects.select("subject_id")
        .join(per_subject, "subject_id", "left")
        .select(
            "subject_id",
            F.coalesce("n_admissions", none).alias("n_admissions"),
            F.coalesce("n_positive_admissions", none).alias("n_positive_admissions"),
        )
        .withColumn("ever_positive", F.col("n_positive_admissions") > 0)
        .withColumn("admission_bucket", count_band("n_admissions"))
        .withColumn(
            "stratum",
            F.concat(
                F.when(F.col("ever_positive"), "positive").otherwise("negative"),
                F.lit("_"),
                F.col("admission_bucket"),
            ),
        )
    )


def assign_folds(
    strata: DataFrame,
    fractions: Mapping[str, float] = fixed.FOLD_FRACTIONS,
    seed: int = fixed.FOLD_SEED,
    rows_per_block: int | None = None,
) -> DataFrame:
    """``subject_id, stratum, fold``: rank by hash within the stratum, cut at the fractions."""
    if any(f < 0 for f in fractions.values()):
        raise ValueError("fractions must not be negative")
    if not math.isclose(sum(fractions.values()), 1.0):
        raise ValueError(f"fractions sum to {sum(fractions.values())}, not 1")

    ranked = number_rows(
        strata.select("subject_id", "stratum").withColumn("_hash", stable_hash(seed, "subject_id")),
        ["stratum"], ["_hash", "subject_id"], "_place",
        group_size="_size", rows_per_block=rows_per_block,
    )
    rank = F.col("_place") / F.col("_size")
    *named, rest = fractions
    bounds = accumulate(fractions[name] for name in named)
    fold = F.lit(rest)
    for name, bound in reversed(list(zip(named, bounds))):
        fold = F.when(rank < bound, name).otherwise(fold)
    return ranked.select("subject_id", "stratum", fold.alias("fold"))


def fold_crosstab(folds: DataFrame, names=tuple(fixed.FOLD_FRACTIONS)) -> DataFrame:
    """Subjects per stratum and fold, one column per fold."""
    return (
        folds.groupBy("stratum").pivot("fold", list(names)).count().na.fill(0, list(names))
    )
