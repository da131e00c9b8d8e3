"""The query register, and the given tables dressed in the shapes the operators expect.

Each dressed frame has a SQL twin (a common table expression) that builds the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL twin if there is one."""
    def register(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_rows(df: DataFrame, blocks: int) -> int:
    """Rows per block that cut a table into about so many blocks, whatever its size.

    The queries named ``*_split`` and a few others use it to cut keys that are not heavy, so that
    the split path is compared with SQL at every scale.
    """
    return max(2, df.count() // blocks)


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


# ---- Hospital-like event table ------------------------------------------------------------
# A subject is a user, an admission a user's calendar week, an intensive-care stay a user's week
# too. Views are creatinine draws, clicks and signups urine in and out, purchases weights, errors
# billed diagnoses. Chart times are whole hours, as charted values tend to be.

def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and week: ids, first and last moment."""
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.date_trunc("week", "ts").alias("week"))
        .agg(F.min("ts").alias("admittime"), F.max("ts").alias("dischtime"), F.count(F.lit(1)).alias("n"))
        .withColumn("visit_id", visit_id("user_id", "week"))
    )


def visit_id(user: str, at: str):
    return F.col(user) * 100 + F.weekofyear(at)


VISITS = """
visits AS (
  SELECT user_id, date_trunc('week', ts) AS week, min(ts) AS admittime, max(ts) AS dischtime,
         count(*) AS n, user_id * 100 + weekofyear(date_trunc('week', ts)) AS visit_id
  FROM events GROUP BY user_id, date_trunc('week', ts))
"""

LAB_LABEL = "labevents/label"
LAB_VALUE = "labevents/valuenum"
ICD_VERSION = "diagnoses_icd/icd_version"
ICD_CODE = "diagnoses_icd/icd_code"


def hospital_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissions, creatinine draws and billed diagnoses in one wide table."""
    events = table(spark, sf_dir, "events").withColumn(
        "hadm_id", visit_id("user_id", "ts").cast("string")
    )
    admissions = visits(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("patient_id"),
        F.lit("admissions").alias("event_type"),
        F.col("admittime").alias("timestamp"),
        F.col("visit_id").cast("string").alias("hadm_id"),
    )
    kind = F.col("event_type")
    value = F.col("value")
    coded = kind == "error"
    drawn = kind == "view"
    others = events.filter(coded | drawn).select(
        F.col("user_id").cast("string").alias("patient_id"),
        F.when(drawn, "labevents").otherwise("diagnoses_icd").alias("event_type"),
        F.col("ts").alias("timestamp"),
        "hadm_id",
        F.when(drawn & (value < 200), "Creatinine").when(drawn, "Sodium").alias(LAB_LABEL),
        F.when(drawn, value / 50).alias(LAB_VALUE),
        F.when(coded, F.when(value < 50, "9").otherwise("10")).alias(ICD_VERSION),
        F.when(
            coded,
            F.when(value < 20, "5849").when(value < 50, "4019").when(value < 80, "N179").otherwise("I10"),
        ).alias(ICD_CODE),
    )
    return admissions.unionByName(others, allowMissingColumns=True)


HOSPITAL = VISITS.strip() + """,
hospital AS (
  SELECT CAST(user_id AS VARCHAR) AS patient_id, 'admissions' AS event_type, admittime AS timestamp,
         CAST(visit_id AS VARCHAR) AS hadm_id, NULL AS label, NULL AS valuenum, NULL AS icd_version,
         NULL AS icd_code
  FROM visits
  UNION ALL
  SELECT CAST(user_id AS VARCHAR), CASE event_type WHEN 'view' THEN 'labevents' ELSE 'diagnoses_icd' END,
         ts, CAST(user_id * 100 + weekofyear(ts) AS VARCHAR),
         CASE WHEN event_type = 'view' THEN CASE WHEN value < 200 THEN 'Creatinine' ELSE 'Sodium' END END,
         CASE WHEN event_type = 'view' THEN value / 50 END,
         CASE WHEN event_type = 'error' THEN CASE WHEN value < 50 THEN '9' ELSE '10' END END,
         CASE WHEN event_type = 'error' THEN CASE WHEN value < 20 THEN '5849' WHEN value < 50 THEN '4019'
              WHEN value < 80 THEN 'N179' ELSE 'I10' END END
  FROM events WHERE event_type IN ('view', 'error'))
"""


def charted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charted rows of all items with numeric ids, as an extract holds them."""
    kind = F.col("event_type")
    item = (
        F.when(kind == "purchase", F.when(F.col("value") > 100, 226531).otherwise(226512))
        .when(kind == "signup", 227488)
        .otherwise(226559)
    )
    return (
        table(spark, sf_dir, "events")
        .filter(kind.isin("purchase", "click", "signup"))
        .select(
            F.col("user_id").alias("subject_id"),
            visit_id("user_id", "ts").alias("hadm_id"),
            visit_id("user_id", "ts").alias("stay_id"),
            item.cast("bigint").alias("itemid"),
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("charttime"),
            F.col("value"),
            F.lit("unit").alias("valueuom"),
            "event_id",
        )
    )


def weight_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        charted(spark, sf_dir)
        .filter(F.col("itemid").isin(226531, 226512))
        .drop("event_id")
        .withColumnRenamed("value", "valuenum")
    )


def urine_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charted(spark, sf_dir).filter(F.col("itemid").isin(226559, 227488)).drop("event_id")


CHARTED = """
charted AS (
  SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(user_id * 100 + weekofyear(ts) AS VARCHAR) AS hadm_id,
         CAST(user_id * 100 + weekofyear(ts) AS VARCHAR) AS stay_id, date_trunc('hour', ts) AS charttime,
         event_type, value
  FROM events WHERE event_type IN ('purchase', 'click', 'signup')),
weights AS (
  SELECT subject_id, hadm_id, charttime,
         max(CASE WHEN value > 100 THEN value * 0.45359237 ELSE value END) AS weight
  FROM charted WHERE event_type = 'purchase' GROUP BY ALL),
urine AS (
  SELECT subject_id, hadm_id, stay_id, charttime,
         sum(CASE WHEN event_type = 'signup' THEN -value ELSE value END) AS volume
  FROM charted WHERE event_type <> 'purchase' GROUP BY ALL)
"""

URINE_RATE = CHARTED.strip() + """,
weighed AS (
  SELECT u.*, w.weight AS matched
  FROM urine u ASOF LEFT JOIN weights w
    ON u.subject_id = w.subject_id AND u.hadm_id = w.hadm_id AND u.charttime >= w.charttime),
filled AS (
  SELECT * EXCLUDE matched, first_value(matched IGNORE NULLS) OVER (PARTITION BY subject_id, hadm_id
           ORDER BY charttime, stay_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight
  FROM weighed),
windowed AS (
  SELECT *, sum(volume) OVER w AS total, min(charttime) OVER w AS started, count(*) OVER w AS n_events
  FROM filled
  WINDOW w AS (PARTITION BY stay_id ORDER BY charttime
               RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)),
urine_rate AS (
  SELECT subject_id AS patient_id, hadm_id, stay_id, charttime, n_events,
         date_sub('second', started, charttime) / 3600.0 AS window_hours,
         CASE WHEN charttime > started
              THEN total / weight / (date_sub('second', started, charttime) / 3600.0) END AS rate
  FROM windowed)
"""

# As the operator has it: volumes to six decimals, whatever the order of their sum, and no rate of weight zero.
EXACT_URINE_RATE = URINE_RATE.replace("sum(volume) OVER w AS total", "round(sum(volume) OVER w, 6) + 0.0 AS total").replace(
    "total / weight /", "total / nullif(weight, 0) /"
)


# ---- Coded events ------------------------------------------------------------------------
# The same users with codes: visits with their end, births, deaths (users whose last event is a
# signup), and every event coded by its type and the number in its props.

def code_of_event():
    return F.concat("event_type", F.lit("/"), F.get_json_object("props", "$.k"))


def coded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject_id, time, code, numeric_value, text_value, end, visit_id, ordinal``."""
    events = table(spark, sf_dir, "events")
    plain = events.select(
        F.col("user_id").alias("subject_id"),
        F.col("ts").alias("time"),
        code_of_event().alias("code"),
        F.col("value").cast("float").alias("numeric_value"),
        F.when(F.col("value") > 100, "high").otherwise("low").alias("text_value"),
        visit_id("user_id", "ts").alias("visit_id"),
        F.col("event_id").alias("ordinal"),
    )
    seen = visits(spark, sf_dir).select(
        F.col("user_id").alias("subject_id"),
        F.col("admittime").alias("time"),
        F.when(F.col("n") % 3 == 0, "Visit/OP")
        .when(F.col("n") % 3 == 1, "Visit/ERIP")
        .otherwise("Visit/IP")
        .alias("code"),
        F.col("dischtime").alias("end"),
        "visit_id",
        F.lit(-1).cast("bigint").alias("ordinal"),
    )
    last = events.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_type", "ts").alias("kind"))
    births = last.select(
        F.col("user_id").alias("subject_id"),
        (F.expr("timestamp_ntz'1960-01-01 06:30:00'") + F.expr("make_dt_interval(cast(user_id * 7 as int))")).alias("time"),
        F.lit("MEDS_BIRTH").alias("code"),
        F.lit(-3).cast("bigint").alias("ordinal"),
    )
    deaths = last.filter(F.col("kind") == "signup").select(
        F.col("user_id").alias("subject_id"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time"),
        F.lit("MEDS_DEATH").alias("code"),
        F.lit(-2).cast("bigint").alias("ordinal"),
    )
    stacked = plain
    for part in (seen, births, deaths):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked


CODED = VISITS.strip() + """,
last_event AS (SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS kind FROM events GROUP BY user_id),
coded AS (
  SELECT user_id AS subject_id, ts AS time, event_type || '/' || (props ->> '$.k') AS code,
         CAST(value AS FLOAT) AS numeric_value, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS text_value,
         user_id * 100 + weekofyear(ts) AS visit_id, event_id AS ordinal, NULL::TIMESTAMP AS "end"
  FROM events
  UNION ALL
  SELECT user_id, admittime, CASE n % 3 WHEN 0 THEN 'Visit/OP' WHEN 1 THEN 'Visit/ERIP' ELSE 'Visit/IP' END,
         NULL, NULL, visit_id, -1, dischtime
  FROM visits
  UNION ALL
  SELECT user_id, TIMESTAMP '1960-01-01 06:30:00' + to_days(CAST(user_id * 7 AS INTEGER)), 'MEDS_BIRTH',
         NULL, NULL, NULL, -3, NULL
  FROM last_event
  UNION ALL
  SELECT user_id, date_trunc('day', ts), 'MEDS_DEATH', NULL, NULL, NULL, -2, NULL
  FROM last_event WHERE kind = 'signup')
"""


def diagnosed_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject_id, visit_id, timestamp``: the first error of a visit above a value, once it has
    lasted 48 hours."""
    errors = table(spark, sf_dir, "events").filter((F.col("event_type") == "error") & (F.col("value") > 40))
    started = visits(spark, sf_dir).select("visit_id", "admittime")
    return (
        errors.withColumn("visit_id", visit_id("user_id", "ts"))
        .join(started, "visit_id")
        .filter(F.col("ts") > F.col("admittime") + F.expr("interval 48 hours"))
        # Its own shuffle lets adaptive execution split the join where one visit is huge.
        .repartition("user_id", "visit_id")
        .groupBy(F.col("user_id").alias("subject_id"), "visit_id")
        .agg(F.min("ts").alias("timestamp"))
    )


DIAGNOSED = """
diagnosed AS (
  SELECT e.user_id AS subject_id, v.visit_id, min(e.ts) AS timestamp
  FROM events e JOIN visits v ON v.visit_id = e.user_id * 100 + weekofyear(e.ts)
  WHERE e.event_type = 'error' AND e.value > 40 AND e.ts > v.admittime + INTERVAL 48 HOURS
  GROUP BY ALL)
"""

GRID = """
windows AS (
  SELECT subject_id, visit_id, code AS visit_code, time AS admittime, "end" AS dischtime
  FROM coded WHERE starts_with(code, 'Visit/')),
eligible AS (
  SELECT w.*, d.timestamp AS diagtime,
         coalesce(m.died BETWEEN CAST(admittime AS DATE) AND CAST(dischtime AS DATE), false) AS died_in_hospital
  FROM windows w
  LEFT JOIN diagnosed d USING (subject_id, visit_id)
  LEFT JOIN (SELECT subject_id, min(CAST(time AS DATE)) AS died FROM coded WHERE code = 'MEDS_DEATH'
             GROUP BY ALL) m USING (subject_id)
  WHERE visit_code IN ('Visit/IP', 'Visit/ERIP') AND admittime < dischtime),
grid AS (
  SELECT e.*, unnest(generate_series(admittime + INTERVAL 48 HOURS,
                     least(dischtime, diagtime) - INTERVAL 1 MICROSECOND, INTERVAL 12 HOURS)) AS prediction_time
  FROM eligible e),
labelled AS (
  SELECT *, date_sub('second', prediction_time, horizon_time) AS _s,
         coalesce(diagtime <= horizon_time, false) AS boolean_value
  FROM (SELECT *, least(prediction_time + INTERVAL 48 HOURS, dischtime) AS horizon_time FROM grid))
"""
