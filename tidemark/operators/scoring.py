"""Scoring a detector against a reference list over the keys both could have named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions.expressions import any_prefix, col


def coded_admissions(
    events: DataFrame, prefixes=fixed.KIDNEY_INJURY_PREFIXES, event_type: str = "diagnoses_icd"
) -> DataFrame:
    """Admissions carrying a diagnosis code with one of the (version, prefix) pairs."""
    wanted = any_prefix(f"{event_type}/icd_version", f"{event_type}/icd_code", prefixes)
    return events.filter(wanted & F.col("hadm_id").isNotNull()).select("hadm_id").distinct()


def evaluable_admissions(events: DataFrame, urine_rate: DataFrame) -> DataFrame:
    """Admissions with a creatinine value or a urine rate, so that a detector could judge them."""
    measured = events.filter(
        (col("labevents/label") == fixed.CREATININE_LABEL) & col("labevents/valuenum").isNotNull()
    ).select("hadm_id")
    both = measured.unionByName(urine_rate.select("hadm_id"))
    return both.filter(F.col("hadm_id").isNotNull()).distinct()


def orphans(evaluable: DataFrame, events: DataFrame, key: str = "hadm_id") -> DataFrame:
    """Evaluable keys that the source population does not hold."""
    return evaluable.join(events.select(key).distinct(), key, "left_anti")


def require_same_population(evaluable: DataFrame, events: DataFrame, key: str = "hadm_id") -> None:
    strays = orphans(evaluable, events, key)
    sample = [r[0] for r in strays.select(key).limit(5).collect()]
    if sample:
        raise ValueError(
            f"{strays.count()} evaluable keys are absent from the source, such as {sample}; "
            "the inputs come from different extracts"
        )


def confusion_matrix(
    predicted: DataFrame, actual: DataFrame, evaluable: DataFrame, key: str = "hadm_id"
) -> DataFrame:
    """2x2 counts over the evaluable keys: ``predicted, actual_positive, actual_negative``.

    The three lists are tagged, stacked and folded per key, so repeats do not count and one
    shuffle serves all four cells.
    """
    def tagged(df: DataFrame, tag: str) -> DataFrame:
        marks = [F.lit(tag == name).alias(name) for name in ("_pred", "_act", "_eval")]
        return df.select(col(key), *marks)

    flags = (
        tagged(predicted, "_pred")
        .unionByName(tagged(actual, "_act"))
        .unionByName(tagged(evaluable, "_eval"))
        .filter(col(key).isNotNull())
        .groupBy(col(key))
        .agg(*[F.max(n).alias(n) for n in ("_pred", "_act", "_eval")])
        .filter("_eval")
    )
    cells = flags.agg(
        F.count_if(F.col("_pred") & F.col("_act")).alias("tp"),
        F.count_if(F.col("_pred") & ~F.col("_act")).alias("fp"),
        F.count_if(~F.col("_pred") & F.col("_act")).alias("fn"),
        F.count_if(~F.col("_pred") & ~F.col("_act")).alias("tn"),
    )
    return cells.select(
        F.inline(
            F.array(
                _matrix_row("positive", "tp", "fp"),
                _matrix_row("negative", "fn", "tn"),
            )
        )
    )


def _matrix_row(label: str, positive: str, negative: str):
    return F.struct(
        F.lit(label).alias("predicted"),
        F.col(positive).alias("actual_positive"),
        F.col(negative).alias("actual_negative"),
    )


def metrics(matrix: DataFrame) -> DataFrame:
    """Seven rates as ``metric, value``; null where the denominator is zero."""
    def cell(label: str, column: str):
        return F.sum(F.when(F.col("predicted") == label, F.col(column)))

    cells = matrix.agg(
        cell("positive", "actual_positive").alias("tp"),
        cell("positive", "actual_negative").alias("fp"),
        cell("negative", "actual_positive").alias("fn"),
        cell("negative", "actual_negative").alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    everything = tp + fp + fn + tn
    rates = {
        "sensitivity": (tp, tp + fn),
        "specificity": (tn, tn + fp),
        "precision": (tp, tp + fp),
        "npv": (tn, tn + fn),
        "f1": (tp * 2, tp * 2 + fp + fn),
        "accuracy": (tp + tn, everything),
        "prevalence": (tp + fn, everything),
    }
    rows = [
        F.struct(F.lit(name).alias("metric"), F.try_divide(top, bottom).alias("value"))
        for name, (top, bottom) in rates.items()
    ]
    return cells.select(F.inline(F.array(*rows)))
