"""Admission windows, landmarks, labels, strata and folds."""

from pyspark.sql import functions as F

from catalog.base import (
    CODED,
    DIAGNOSED,
    GRID,
    block_rows,
    coded_events,
    diagnosed_visits,
    query,
    table,
    with_sql,
)
from tidemark.operators import folds, landmarks
from tidemark.operators.profile import exact_quantiles


@query("windows", with_sql(CODED, DIAGNOSED, GRID) + """
SELECT subject_id, visit_id, visit_code, admittime, dischtime FROM windows
WHERE visit_code IN ('Visit/IP', 'Visit/ERIP') AND admittime < dischtime
""")
def windows(spark, sf_dir):
    found = landmarks.admission_windows(coded_events(spark, sf_dir))
    return landmarks.forward_windows(landmarks.inpatient_windows(found))


@query("death_flag", with_sql(CODED, DIAGNOSED, GRID) + """
SELECT w.visit_id, coalesce(m.died BETWEEN CAST(admittime AS DATE) AND CAST(dischtime AS DATE), false) AS died_in_hospital
FROM windows w LEFT JOIN (SELECT subject_id, min(CAST(time AS DATE)) AS died FROM coded
     WHERE code = 'MEDS_DEATH' GROUP BY ALL) m USING (subject_id)
""")
def death_flag(spark, sf_dir):
    coded = coded_events(spark, sf_dir)
    flagged = landmarks.flag_death(landmarks.admission_windows(coded), coded)
    return flagged.select("visit_id", "died_in_hospital")


@query("onset_join", with_sql(CODED, DIAGNOSED, GRID) + """
SELECT w.visit_id, d.timestamp AS diagtime FROM windows w LEFT JOIN diagnosed d USING (subject_id, visit_id)
""")
def onset_join(spark, sf_dir):
    found = landmarks.admission_windows(coded_events(spark, sf_dir))
    return landmarks.join_onset(found, diagnosed_visits(spark, sf_dir)).select("visit_id", "diagtime")


@query("landmark_grid", with_sql(CODED, DIAGNOSED, GRID) + """
SELECT subject_id, visit_id, prediction_time FROM grid
""")
def landmark_grid(spark, sf_dir):
    found = landmarks.forward_windows(
        landmarks.inpatient_windows(landmarks.admission_windows(coded_events(spark, sf_dir)))
    )
    dated = landmarks.join_onset(found, diagnosed_visits(spark, sf_dir))
    return landmarks.landmark_grid(dated).select("subject_id", "visit_id", "prediction_time")


def labels(spark, sf_dir):
    return landmarks.labelled_landmarks(coded_events(spark, sf_dir), diagnosed_visits(spark, sf_dir))


@query("horizon_labels", with_sql(CODED, DIAGNOSED, GRID) + """
SELECT subject_id, visit_id, visit_code, admittime, dischtime, diagtime, died_in_hospital, prediction_time,
       horizon_time, round(_s / 3600.0, 6) AS horizon_hours, boolean_value
FROM labelled
""")
def horizon_labels(spark, sf_dir):
    return labels(spark, sf_dir).withColumn("horizon_hours", F.round("horizon_hours", 6))


@query("label_summary", with_sql(CODED, DIAGNOSED, GRID) + """
SELECT count(*) AS n_landmarks, count(*) FILTER (boolean_value) AS n_positive,
       count(DISTINCT visit_id) AS n_admissions, count(DISTINCT subject_id) AS n_subjects,
       count(*) FILTER (died_in_hospital) AS n_died,
       round(100.0 * count(*) FILTER (boolean_value) / count(*), 6) AS positive_rate
FROM labelled
""")
def label_summary(spark, sf_dir):
    return landmarks.label_summary(labels(spark, sf_dir)).withColumn(
        "positive_rate", F.round("positive_rate", 6)
    )


@query("label_report", with_sql(CODED, DIAGNOSED, GRID) + """
SELECT boolean_value, count(*) AS n, count(DISTINCT visit_id) AS n_admissions,
       round(quantile_cont(_s / 3600.0, 0.5), 6) AS median_hours
FROM labelled GROUP BY boolean_value
""")
def label_report(spark, sf_dir):
    marked = labels(spark, sf_dir)
    counts = marked.groupBy("boolean_value").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("visit_id").alias("n_admissions")
    )
    medians = exact_quantiles(marked, "horizon_hours", [0.5], by=["boolean_value"])
    return counts.join(medians, "boolean_value").select(
        "boolean_value", "n", "n_admissions", F.round("q0", 6).alias("median_hours")
    )


@query("surviving_events", with_sql(CODED, DIAGNOSED) + """
SELECT d.*, CAST(count(c.visit_id) AS DOUBLE) AS n_surviving_events
FROM diagnosed d LEFT JOIN (SELECT visit_id FROM coded WHERE NOT starts_with(code, 'view')) c USING (visit_id)
GROUP BY ALL
""")
def surviving_events(spark, sf_dir):
    rest = coded_events(spark, sf_dir).filter(~F.col("code").startswith("view"))
    return landmarks.count_surviving_events(diagnosed_visits(spark, sf_dir), rest)


_STRATA = """
per_subject AS (
  SELECT c.subject_id, count(DISTINCT v.visit_id) AS n_admissions,
         count(DISTINCT v.visit_id) FILTER (v.visit_id IN (SELECT visit_id FROM diagnosed)) AS n_positive_admissions
  FROM (SELECT DISTINCT subject_id FROM coded) c
  LEFT JOIN (SELECT DISTINCT subject_id, visit_id FROM coded WHERE visit_id IS NOT NULL AND code NOT LIKE 'Visit/%') v
    USING (subject_id) GROUP BY ALL),
strata AS (
  SELECT *, n_positive_admissions > 0 AS ever_positive,
         CASE WHEN n_admissions = 0 THEN '0' WHEN n_admissions = 1 THEN '1' WHEN n_admissions <= 3 THEN '2-3'
              ELSE '4+' END AS admission_bucket
  FROM per_subject),
named AS (
  SELECT *, CASE WHEN ever_positive THEN 'positive' ELSE 'negative' END || '_' || admission_bucket AS stratum
  FROM strata)
"""


@query("strata", with_sql(CODED, DIAGNOSED, _STRATA) + "SELECT * FROM named")
def strata(spark, sf_dir):
    coded = coded_events(spark, sf_dir)
    kept = coded.filter(~F.col("code").startswith("Visit/"))
    return folds.subject_strata(folds.subject_universe(coded), kept, diagnosed_visits(spark, sf_dir))


_CUSTOMER_STRATA = """
strata AS (
  SELECT c_custkey AS subject_id,
         CASE WHEN c_acctbal > 5000 THEN 'positive' ELSE 'negative' END || '_' || c_mktsegment AS stratum
  FROM customer)
"""
_FOLDS = """
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY
               sha256(unhex(printf('%016x', 42) || printf('%016x', subject_id)))[1:16], subject_id) - 1)
            / count(*) OVER (PARTITION BY stratum) AS place
  FROM strata),
folds AS (
  SELECT subject_id, stratum, CASE WHEN place < 0.7::DOUBLE THEN 'training'
         WHEN place < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'testing' END AS fold
  FROM ranked)
"""


def _customer_folds(spark, sf_dir, rows_per_block=None):
    strata = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        F.concat(
            F.when(F.col("c_acctbal") > 5000, "positive").otherwise("negative"), F.lit("_"), "c_mktsegment"
        ).alias("stratum"),
    )
    return folds.assign_folds(strata, rows_per_block=rows_per_block)


@query("hash_split", with_sql(_CUSTOMER_STRATA, _FOLDS) + "SELECT * FROM folds")
def hash_split(spark, sf_dir):
    """Strata cut into about a hundred blocks in all."""
    return _customer_folds(spark, sf_dir, block_rows(table(spark, sf_dir, "customer"), 100))


@query("subject_folds", with_sql(CODED, DIAGNOSED, _STRATA.replace("strata AS", "banded AS")
       .replace("FROM strata", "FROM banded").replace("named AS", "strata AS"), _FOLDS) + "SELECT * FROM folds")
def subject_folds(spark, sf_dir):
    return folds.assign_folds(strata(spark, sf_dir))


@query("split_crosstab", with_sql(_CUSTOMER_STRATA, _FOLDS) + """
SELECT stratum, count(*) FILTER (fold = 'training') AS training, count(*) FILTER (fold = 'validation') AS validation,
       count(*) FILTER (fold = 'testing') AS testing
FROM folds GROUP BY stratum
""")
def split_crosstab(spark, sf_dir):
    return folds.fold_crosstab(_customer_folds(spark, sf_dir))
