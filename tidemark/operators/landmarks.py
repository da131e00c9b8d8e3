"""Admission windows and the labelled grid of prediction times laid over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions.expressions import duration, hours_between


def admission_windows(events: DataFrame) -> DataFrame:
    """``subject_id, visit_id, visit_code, admittime, dischtime`` from the visit events."""
    return events.filter(F.col("code").startswith(fixed.VISIT_PREFIX)).select(
        "subject_id",
        "visit_id",
        F.col("code").alias("visit_code"),
        F.col("time").alias("admittime"),
        F.col("end").alias("dischtime"),
    )


def inpatient_windows(windows: DataFrame) -> DataFrame:
    return windows.filter(F.col("visit_code").isin(*fixed.INPATIENT_VISITS))


def forward_windows(windows: DataFrame) -> DataFrame:
    """Windows that end after they start."""
    return windows.filter(F.col("admittime") < F.col("dischtime"))


def flag_death(windows: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``died_in_hospital``: the death date lies on or between the window's dates."""
    deaths = (
        events.filter(F.col("code") == fixed.DEATH_CODE)
        .groupBy("subject_id")
        .agg(F.min(F.to_date("time")).alias("_died"))
    )
    inside = F.col("_died").between(F.to_date("admittime"), F.to_date("dischtime"))
    return (
        windows.join(deaths, "subject_id", "left")
        .withColumn("died_in_hospital", F.coalesce(inside, F.lit(False)))
        .drop("_died")
    )


def join_onset(windows: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Add ``diagtime``, null for windows without a diagnosis."""
    onset = diagnoses.select(
        "subject_id", "visit_id", F.col("timestamp").cast("timestamp_ntz").alias("diagtime")
    )
    return windows.join(onset, ["subject_id", "visit_id"], "left")


def landmark_grid(windows: DataFrame, step: str = fixed.LANDMARK_STEP) -> DataFrame:
    """One row per ``prediction_time``: from 48 h after admission, every step, before the end.

    The end is the discharge or the onset, whichever is first, and is itself left out. Windows
    that end too early give no row.
    """
    first = F.col("admittime") + F.lit(duration(fixed.FIRST_LANDMARK_AFTER))
    end = F.least("dischtime", "diagtime")
    last = end - F.expr("interval 1 microsecond")
    times = F.when(first < end, F.sequence(first, last, F.lit(duration(step))))
    return windows.withColumn("prediction_time", F.explode(times))


def label_horizon(grid: DataFrame, horizon: str = fixed.LABEL_HORIZON) -> DataFrame:
    """Add ``horizon_time``, ``horizon_hours`` and ``boolean_value`` (onset by horizon end)."""
    ahead = F.col("prediction_time") + F.lit(duration(horizon))
    return grid.withColumn("horizon_time", F.least(ahead, F.col("dischtime"))).withColumns(
        {
            "horizon_hours": hours_between("prediction_time", "horizon_time"),
            "boolean_value": F.coalesce(F.col("diagtime") <= F.col("horizon_time"), F.lit(False)),
        }
    )


def labelled_landmarks(
    events: DataFrame,
    diagnoses: DataFrame,
    step: str = fixed.LANDMARK_STEP,
    horizon: str = fixed.LABEL_HORIZON,
) -> DataFrame:
    """The whole grid of labelled landmarks over the inpatient admissions."""
    windows = forward_windows(inpatient_windows(admission_windows(events)))
    dated = flag_death(join_onset(windows, diagnoses), events)
    return label_horizon(landmark_grid(dated, step), horizon)


def label_summary(labels: DataFrame) -> DataFrame:
    """One row of counts over the landmarks, and the share that is positive."""
    return labels.agg(
        F.count(F.lit(1)).alias("n_landmarks"),
        F.count_if("boolean_value").alias("n_positive"),
        F.count_distinct("visit_id").alias("n_admissions"),
        F.count_distinct("subject_id").alias("n_subjects"),
        F.count_if("died_in_hospital").alias("n_died"),
    ).withColumn(
        "positive_rate",
        F.coalesce(F.try_divide(F.col("n_positive") * 100.0, F.col("n_landmarks")), F.lit(0.0)),
    )


def count_surviving_events(diagnoses: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``n_surviving_events``: events of the diagnosed admission, 0.0 when none is left."""
    counts = events.groupBy("visit_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        diagnoses.join(counts, "visit_id", "left")
        .withColumn("n_surviving_events", F.coalesce(F.col("_n").cast("double"), F.lit(0.0)))
        .drop("_n")
    )
