"""Detecting the onset of acute kidney injury from laboratory values and urine output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions.expressions import col, duration, hours_between
from tidemark.operators import scoring
from tidemark.operators.align import asof_backfill
from tidemark.operators.blocks import heavy_splits
from tidemark.operators.clean import net_urine, weights_in_kilograms
from tidemark.operators.rolling import sum_in_order, trailing
from tidemark.session import cut_lineage


def urine_rate(
    weights: DataFrame, urine: DataFrame, rows_per_block: int | None = None, rounded: bool = True
) -> DataFrame:
    """Urine output in mL/kg/h over the trailing six hours of each stay.

    The weight is the admission's latest at the time, or for earlier rows the next one that a
    urine row got. The span is the observed one: a window holding a single moment has no rate,
    and neither has a row without weight or of weight zero. A rate may be negative. The volume of a window
    counts to six decimals, so that volumes which cancel out are zero in whatever order they were added; with
    ``rounded`` false it is the plain sum in the order of time.
    """
    weighings = weights.select("subject_id", "hadm_id", "charttime", col("valuenum").alias("weight"))
    # One look at the admissions serves both steps of the alignment.
    admission = ["subject_id", "hadm_id"]
    moments = urine.select(*admission, "charttime").unionByName(weighings.select(*admission, "charttime"))
    crowded = heavy_splits(moments, admission, ["charttime"], rows_per_block) is not None
    weighed = asof_backfill(
        urine,
        weighings,
        on="charttime",
        by=admission,
        value="weight",
        left_tie=["stay_id"],
        rows_per_block=rows_per_block,
        may_be_heavy=crowded,
    )
    aggregates = {"_start": ("min", col("charttime")), "n_events": ("count", F.lit(1))}
    if rounded:
        aggregates["_volume"] = ("sum", col("valuenum"))
    else:
        weighed = sum_in_order(weighed, ["stay_id"], "charttime", fixed.URINE_WINDOW, "_volume", col("valuenum"))
    windowed = trailing(
        weighed,
        ["stay_id"],
        "charttime",
        fixed.URINE_WINDOW,
        aggregates,
        closed="both",
        rows_per_block=rows_per_block,
    ).withColumn("window_hours", hours_between("_start", "charttime"))
    volume = F.round("_volume", 6) if rounded else F.col("_volume")
    per_hour = F.try_divide(F.try_divide(volume, F.col("weight")), F.col("window_hours"))
    return windowed.select(
        "subject_id",
        "hadm_id",
        "stay_id",
        "charttime",
        F.when(F.col("window_hours") > 0, per_hour).alias("rate"),
        "window_hours",
        "n_events",
    )


def load_urine_rate(
    weights: DataFrame, outputs: DataFrame, only_in: DataFrame | None = None, rounded: bool = True
) -> DataFrame:
    """Urine rate from the two extracts, keyed by ``patient_id``.

    Args:
        weights: the weight extract; ids may be numbers.
        outputs: the urine extract, its volume in ``value``.
        only_in: if given, keep only admissions that occur in this frame's ``hadm_id``.
        rounded: see ``urine_rate``.
    """
    def text_ids(df: DataFrame) -> DataFrame:
        ids = ("subject_id", "hadm_id", "stay_id", "itemid")
        return df.withColumns({c: col(c).cast("string") for c in ids})

    rate = urine_rate(
        weights_in_kilograms(text_ids(weights)),
        net_urine(text_ids(outputs).withColumnRenamed("value", "valuenum")),
        rounded=rounded,
    ).withColumnRenamed("subject_id", "patient_id")
    if only_in is not None:
        rate = rate.join(only_in.select("hadm_id").distinct(), "hadm_id", "left_semi")
    return rate


def first_admission_times(events: DataFrame) -> DataFrame:
    """``hadm_id, admittime``: the earliest admission event of each admission."""
    return (
        events.filter((F.col("event_type") == "admissions") & F.col("hadm_id").isNotNull())
        .groupBy("hadm_id")
        .agg(F.min("timestamp").alias("admittime"))
    )


def creatinine_onset(events: DataFrame, rows_per_block: int | None = None) -> DataFrame:
    """First time per admission that creatinine rises far enough, as ``cr_time``.

    Far enough is an absolute rise over the trailing 48 h minimum, or a multiple of the baseline,
    the earliest value within 24 h of admission. Without a baseline only the first rule applies.
    """
    draws = events.filter(
        (col("labevents/label") == fixed.CREATININE_LABEL)
        & col("labevents/valuenum").isNotNull()
        & F.col("timestamp").isNotNull()
    ).select("patient_id", "hadm_id", "timestamp", col("labevents/valuenum").alias("_value"))
    # Comparing in the column's own type keeps single-precision values on the right side of a
    # threshold.
    own_type = draws.schema["_value"].dataType
    rise = F.lit(fixed.ABSOLUTE_RISE).cast(own_type)
    ratio = F.lit(fixed.RELATIVE_RISE).cast(own_type)

    # The earliest value within 24 h is the earliest value of all, if that is within 24 h.
    earliest = draws.groupBy("hadm_id").agg(F.min(F.struct("timestamp", "_value")).alias("_first"))
    in_time = F.col("_first.timestamp") <= F.col("admittime") + F.lit(duration(fixed.BASELINE_WINDOW))
    baseline = (
        earliest.join(first_admission_times(events), "hadm_id")
        .filter(in_time)
        .select("hadm_id", F.col("_first._value").alias("_baseline"))
    )
    lows = trailing(
        draws, ["hadm_id"], "timestamp", fixed.RISE_WINDOW,
        {"_low": ("min", F.col("_value"))}, rows_per_block=rows_per_block,
    )
    rose = (F.col("_value") - F.col("_low") >= rise) | F.coalesce(
        F.col("_value") >= (F.col("_baseline") * ratio).cast(own_type), F.lit(False)
    )
    return (
        lows.join(baseline, "hadm_id", "left")
        .filter(rose)
        # Few rows are left here; their own shuffle lets adaptive execution split a skewed join.
        .repartition("patient_id", "hadm_id")
        .groupBy("patient_id", "hadm_id")
        .agg(F.min("timestamp").alias("cr_time"))
    )


def urine_onset(rate: DataFrame) -> DataFrame:
    """First time per admission that the rate is low over a full window, as ``uo_time``."""
    return (
        rate.filter(
            (F.col("rate") >= 0)
            & (F.col("rate") < fixed.LOW_URINE_RATE)
            & (F.col("window_hours") >= fixed.URINE_WINDOW_HOURS)
        )
        .groupBy("patient_id", "hadm_id")
        .agg(F.min("charttime").alias("uo_time"))
    )


def detect_onset(
    events: DataFrame, rate: DataFrame, rows_per_block: int | None = None
) -> DataFrame:
    """Onset per admission: the earlier of the creatinine and the urine arm."""
    arms = creatinine_onset(events, rows_per_block).join(
        urine_onset(rate), ["patient_id", "hadm_id"], "full"
    )
    return arms.select(
        "patient_id",
        "hadm_id",
        F.least("cr_time", "uo_time").alias("timestamp"),
        F.lit(fixed.DIAGNOSIS_EVENT).alias("event_type"),
        F.lit(fixed.DIAGNOSIS_NAME).alias("diagnosis"),
    )


def detect_acquired_onset(
    events: DataFrame, rate: DataFrame, rows_per_block: int | None = None
) -> DataFrame:
    """Onsets strictly later than 48 h after admission; an earlier onset rules out the admission."""
    assigned = events.filter(F.col("hadm_id").isNotNull())
    gate = F.col("admittime") + F.lit(duration(fixed.ACQUIRED_AFTER))
    return (
        detect_onset(assigned, rate, rows_per_block)
        .join(first_admission_times(assigned), "hadm_id")
        .filter(F.col("timestamp") > gate)
        .select("event_type", "patient_id", "hadm_id", "timestamp", "diagnosis")
    )


def diagnosis_events(events: DataFrame, rate: DataFrame) -> DataFrame:
    """The acquired onsets as events of their own type."""
    return detect_acquired_onset(events, rate).withColumnRenamed(
        "diagnosis", f"{fixed.DIAGNOSIS_EVENT}/diagnosis"
    )


def with_diagnoses(events: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """The event table with diagnosis events appended; columns either side lacks are null."""
    return events.unionByName(diagnoses, allowMissingColumns=True)


def validate_detector(events: DataFrame, rate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confusion matrix and metrics of the ungated detector against the billing codes."""
    assigned = events.filter(F.col("hadm_id").isNotNull())
    # Both are read by the guard and by the matrix.
    rate = cut_lineage(rate)
    evaluable = cut_lineage(scoring.evaluable_admissions(assigned, rate))
    scoring.require_same_population(evaluable, assigned)
    matrix = scoring.confusion_matrix(
        detect_onset(assigned, rate).select("hadm_id"),
        scoring.coded_admissions(assigned),
        evaluable,
    )
    return matrix, scoring.metrics(matrix)


