"""Raw tables that arrive as rows of delimited text, turned into one event table.

The text rows are written from the given tables: labs are views, prescriptions clicks (with messy doses),
admissions a user's weeks. Values hold commas and quotes.
"""

from pyspark.sql import functions as F

from catalog.base import VISITS, charted, query, table, visit_id, visits, with_sql
from tidemark.functions.fixed_values import WEIGHT_COLUMNS, WEIGHT_ITEMS, RawTable
from tidemark.plans.event_table import canonical_table
from tidemark.sources.readers import item_rows, parse_text_rows, raw_events, stacked

TABLES = {
    "admissions": RawTable("", "admittime", {
        "hadm_id": None, "admission_type": "String", "dischtime": "DateTime", "hospital_expire_flag": "Boolean", "admitdate": "Date",
    }),
    "labevents": RawTable("", "charttime", {
        "hadm_id": "String", "itemid": None, "valuenum": "Float", "valueuom": "String", "storetime": "DateTime",
    }),
    "prescriptions": RawTable("", "starttime", {"hadm_id": "String", "drug": "String", "dose_val_rx": "Float", "seq_num": "UInt"}),
}
_SECOND = "yyyy-MM-dd HH:mm:ss"


def text_rows(spark, sf_dir):
    """Per raw table the names of its columns and its rows as text."""
    events = table(spark, sf_dir, "events").withColumn("hadm_id", visit_id("user_id", "ts"))
    cents = F.floor(F.col("value") * 100).cast("bigint")
    dose = (
        F.when(F.col("event_id") % 3 == 0, F.format_number(cents, 0))
        .when(F.col("event_id") % 3 == 1, F.concat_ws("-", cents.cast("string"), (cents + 2).cast("string")))
        .otherwise("n/a")
    )
    at = F.date_format("ts", _SECOND)
    frames = {
        "admissions": visits(spark, sf_dir).select(
            F.col("user_id").alias("subject_id"), F.col("visit_id").alias("hadm_id"),
            F.date_format("admittime", _SECOND).alias("admittime"), F.date_format("dischtime", _SECOND).alias("dischtime"),
            F.when(F.col("n") % 2 == 0, "URGENT, \"now\"").otherwise("ELECTIVE").alias("admission_type"),
            (F.col("n") % 2).alias("hospital_expire_flag"), F.to_date("admittime").cast("string").alias("admitdate"),
        ),
        "labevents": events.filter("event_type = 'view'").select(
            F.col("user_id").alias("subject_id"), "hadm_id", at.alias("charttime"),
            F.when(F.col("event_id") % 5 > 0, at).alias("storetime"), (F.col("event_id") % 50 + 1).alias("itemid"),
            F.format_number(cents, 0).alias("valuenum"), F.lit("mg/dL, approx").alias("valueuom"),
        ),
        "prescriptions": events.filter("event_type = 'click'").select(
            F.col("user_id").alias("subject_id"), "hadm_id", at.alias("starttime"),
            F.concat(F.lit('A "drug", '), (F.col("event_id") % 7).cast("string")).alias("drug"), dose.alias("dose_val_rx"),
            (F.col("event_id") % 60000).alias("seq_num"),
        ),
    }
    return {
        name: (df.columns, df.select(F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns]), {"escape": '"'}).alias("value")))
        for name, df in frames.items()
    }


def raw_parts(spark, sf_dir):
    return {
        name: raw_events(parse_text_rows(lines, columns), name, TABLES[name])
        for name, (columns, lines) in text_rows(spark, sf_dir).items()
    }


_CENTS = "CAST(floor(value * 100) AS BIGINT)"
_RAW = f"""
raw AS (
  SELECT CAST(user_id AS VARCHAR) AS patient_id, 'admissions' AS event_type, date_trunc('second', admittime) AS timestamp,
         CAST(visit_id AS VARCHAR) AS hadm_id, CASE n % 2 WHEN 0 THEN 'URGENT, "now"' ELSE 'ELECTIVE' END AS admission_type,
         date_trunc('second', dischtime) AS dischtime, n % 2 AS expired, CAST(admittime AS DATE) AS admitdate,
         NULL AS itemid, NULL AS cents, NULL AS valueuom, NULL::TIMESTAMP AS storetime, NULL AS drug, NULL AS kind, NULL AS seq_num
  FROM visits
  UNION ALL
  SELECT CAST(user_id AS VARCHAR), CASE event_type WHEN 'view' THEN 'labevents' ELSE 'prescriptions' END, date_trunc('second', ts),
         CAST(user_id * 100 + weekofyear(ts) AS VARCHAR), NULL, NULL, NULL, NULL,
         CASE WHEN event_type = 'view' THEN event_id % 50 + 1 END, {_CENTS},
         CASE WHEN event_type = 'view' THEN 'mg/dL, approx' END,
         CASE WHEN event_type = 'view' AND event_id % 5 > 0 THEN date_trunc('second', ts) END,
         CASE WHEN event_type = 'click' THEN 'A "drug", ' || event_id % 7 END,
         CASE WHEN event_type = 'click' THEN event_id % 3 END, CASE WHEN event_type = 'click' THEN event_id % 60000 END
  FROM events WHERE event_type IN ('view', 'click'))
"""


@query("raw_event_table", with_sql(VISITS, _RAW) + """
SELECT patient_id, event_type, timestamp, admission_type AS "admissions/admission_type",
       CAST(expired AS VARCHAR) AS "admissions/hospital_expire_flag",
       CASE WHEN event_type = 'admissions' THEN hadm_id END AS "admissions/hadm_id",
       CASE WHEN event_type = 'labevents' THEN hadm_id END AS "labevents/hadm_id", CAST(itemid AS VARCHAR) AS "labevents/itemid",
       CASE WHEN event_type = 'labevents' THEN format('{:,}', cents) END AS "labevents/valuenum", valueuom AS "labevents/valueuom",
       drug AS "prescriptions/drug", CAST(seq_num AS VARCHAR) AS "prescriptions/seq_num",
       CASE kind WHEN 0 THEN format('{:,}', cents) WHEN 1 THEN cents || '-' || cents + 2 WHEN 2 THEN 'n/a' END AS "prescriptions/dose_val_rx"
FROM raw
""")
def raw_event_table(spark, sf_dir):
    """Text rows of three raw tables as one wide, sparse table of events; values are still text."""
    names = ["admissions/admission_type", "admissions/hospital_expire_flag", "admissions/hadm_id", "labevents/hadm_id",
             "labevents/itemid", "labevents/valuenum", "labevents/valueuom", "prescriptions/drug", "prescriptions/seq_num",
             "prescriptions/dose_val_rx"]
    whole = stacked(list(raw_parts(spark, sf_dir).values()))
    return whole.select("patient_id", "event_type", "timestamp", *[F.col(f"`{n}`") for n in names])


@query("canonical_events", with_sql(VISITS, _RAW) + """
SELECT patient_id, event_type, timestamp, hadm_id, admission_type AS "admissions/admission_type", dischtime AS "admissions/dischtime",
       expired = 1 AS "admissions/hospital_expire_flag", admitdate AS "admissions/admitdate", p_name AS "labevents/description",
       CASE WHEN event_type = 'labevents' THEN cents::DOUBLE END AS "labevents/valuenum", valueuom AS "labevents/valueuom",
       storetime AS "labevents/storetime", drug AS "prescriptions/drug", seq_num::INTEGER AS "prescriptions/seq_num",
       CASE kind WHEN 0 THEN cents::DOUBLE WHEN 1 THEN cents + 1::DOUBLE END AS "prescriptions/dose_val_rx"
FROM raw LEFT JOIN part ON p_partkey = itemid
""")
def canonical_events(spark, sf_dir):
    """The same tables sliced, cleaned, cast, described and with one admission column."""
    dictionary = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"))
    events = canonical_table(raw_parts(spark, sf_dir), TABLES, {"labevents": dictionary})
    return events.withColumns({c: F.col(f"`{c}`").cast("double") for c in ("labevents/valuenum", "prescriptions/dose_val_rx")})


@query("item_extract", """
SELECT user_id AS subject_id, user_id * 100 + weekofyear(ts) AS hadm_id, user_id * 100 + weekofyear(ts) AS stay_id,
       date_trunc('hour', ts) AS charttime, CAST(CASE WHEN value > 100 THEN 226531 ELSE 226512 END AS BIGINT) AS itemid,
       floor(value * 100) AS valuenum, 'kg, "dry"' AS valueuom
FROM events WHERE event_type = 'purchase'
""")
def item_extract(spark, sf_dir):
    """The rows of a charting table, in text, that hold a weight."""
    names = ["subject_id", "hadm_id", "stay_id", "caregiver_id", "charttime", "itemid", "valuenum", "valueuom"]
    rows = charted(spark, sf_dir).withColumns({
        "charttime": F.date_format("charttime", _SECOND), "caregiver_id": F.lit(None), "valuenum": F.floor(F.col("value") * 100),
        "valueuom": F.lit('kg, "dry"'),
    })
    lines = rows.select(F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in names]), {"escape": '"'}).alias("value"))
    return item_rows(parse_text_rows(lines, names), WEIGHT_COLUMNS, WEIGHT_ITEMS, "valuenum")
