"""Cleaning, casting and profiling."""

from pyspark.sql import functions as F

from catalog.base import block_rows, query, table, visit_id
from tidemark.operators.clean import cast_columns, clean_numbers, describe_coded, describe_items, unify_visit
from tidemark.operators.profile import EventProfile, exact_quantiles, mostly_complete, value_shares


def wide(spark, sf_dir):
    """Views and clicks with their own prefixed columns."""
    def only(kind, value):
        return F.when(F.col("event_type") == kind, value)

    value = F.col("value")
    band = F.when(value < 20, "low").when(value < 100, "mid")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("patient_id"),
        "event_type",
        F.col("ts").alias("timestamp"),
        visit_id("user_id", "ts").cast("string").alias("hadm_id"),
        only("view", value).alias("view/value"),
        only("view", band).alias("view/band"),
        only("view", F.when(value >= 20, "mg")).alias("view/unit"),
        only("view", F.when(value < 50, F.get_json_object("props", "$.k"))).alias("view/k"),
        only("click", value).alias("click/value"),
        only("click", band).alias("click/band"),
    )


_WIDE = """
WITH wide AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS patient_id, event_type, ts AS timestamp,
         CAST(user_id * 100 + weekofyear(ts) AS VARCHAR) AS hadm_id, value,
         CASE WHEN value < 20 THEN 'low' WHEN value < 100 THEN 'mid' END AS band,
         CASE WHEN value >= 20 THEN 'mg' END AS unit,
         CASE WHEN value < 50 THEN props ->> '$.k' END AS k
  FROM events)
"""


@query("event_counts", "SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_patients FROM events GROUP BY ALL")
def event_counts(spark, sf_dir):
    return EventProfile(wide(spark, sf_dir)).counts()


@query("distinct_values", _WIDE + """
SELECT DISTINCT band AS "view/band", k AS "view/k" FROM wide
WHERE event_type = 'view' AND band IS NOT NULL AND k IS NOT NULL AND unit = 'mg'
""")
def distinct_values(spark, sf_dir):
    return EventProfile(wide(spark, sf_dir)).distinct_values(["view/band", "view/k"], {"view/unit": "mg"})


@query("category_share", _WIDE + """
SELECT band AS "view/band", round(count(*) / sum(count(*)) OVER (), 9) AS proportion
FROM wide WHERE event_type = 'view' GROUP BY band
""")
def category_share(spark, sf_dir):
    shares = EventProfile(wide(spark, sf_dir)).describe_categorical("view/band")
    return shares.withColumn("proportion", F.round("proportion", 9))


@query("top_categories", """
SELECT k, round(n / sum(n) OVER (), 9) AS proportion
FROM (SELECT props ->> '$.k' AS k, count(*) AS n FROM events GROUP BY ALL)
ORDER BY n DESC, k LIMIT 20
""")
def top_categories(spark, sf_dir):
    """The twenty largest shares."""
    events = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k"))
    return value_shares(events, "k").limit(20).withColumn("proportion", F.round("proportion", 9))


@query("describe", _WIDE + """
SELECT count(value) AS count, count(*) - count(value) AS null_count, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max
FROM wide WHERE event_type = 'view' AND band = 'mid'
""")
def describe(spark, sf_dir):
    summary = EventProfile(wide(spark, sf_dir)).describe_numeric("view/value", {"view/band": "mid"}, "view/unit")
    rounded = {c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")}
    return summary.stats.withColumns(rounded)


@query("quantiles", """
SELECT round(quantile_cont(o_totalprice, 0.01), 4) AS q0, round(quantile_cont(o_totalprice, 0.5), 4) AS q1,
       round(quantile_cont(o_totalprice, 0.999), 4) AS q2
FROM orders
""")
def quantiles(spark, sf_dir):
    """Exact quantiles, the ranking cut into about a hundred blocks."""
    orders = table(spark, sf_dir, "orders")
    found = exact_quantiles(
        orders, "o_totalprice", [0.01, 0.5, 0.999], rows_per_block=block_rows(orders, 100)
    )
    return found.select(*[F.round(c, 4).alias(c) for c in found.columns])


@query("histogram", """
WITH v AS (SELECT value FROM events WHERE event_type = 'view'),
     b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 12 AS width FROM v),
     placed AS (SELECT least(12, greatest(1, ceil((value - lo) / width)))::BIGINT AS bin FROM v, b)
SELECT g.bin, round(lo + g.bin * width, 6) AS breakpoint, count(p.bin) AS count
FROM (SELECT unnest(range(1, 13)) AS bin) g CROSS JOIN b LEFT JOIN placed p ON p.bin = g.bin
GROUP BY g.bin, lo, width
""")
def histogram(spark, sf_dir):
    bins = EventProfile(wide(spark, sf_dir)).histogram("view/value", {}, 12)
    return bins.withColumn("breakpoint", F.round("breakpoint", 6))


@query("mostly_complete", _WIDE + """
SELECT event_id FROM wide
WHERE event_type = 'view' AND (value IS NOT NULL)::INT + (band IS NOT NULL)::INT + (unit IS NOT NULL)::INT
      + (k IS NOT NULL)::INT > 0.6 * 4
""")
def complete_rows(spark, sf_dir):
    """The rows a preview of views would choose from."""
    names = ["view/value", "view/band", "view/unit", "view/k"]
    return mostly_complete(wide(spark, sf_dir), names).select("event_id")


@query("preview", _WIDE + """
SELECT event_id FROM wide WHERE event_type = 'click' AND band IS NOT NULL ORDER BY event_id LIMIT 25
""")
def preview(spark, sf_dir):
    """The first rows of clicks that are complete enough."""
    names = EventProfile(wide(spark, sf_dir)).fields("click")
    return mostly_complete(wide(spark, sf_dir), names).orderBy("event_id").limit(25).select("event_id")


@query("timeline", _WIDE + """,
busiest AS (SELECT hadm_id FROM wide GROUP BY hadm_id ORDER BY count(*) DESC, hadm_id LIMIT 1)
SELECT patient_id, hadm_id, event_type, timestamp FROM wide WHERE hadm_id = (SELECT hadm_id FROM busiest)
""")
def timeline(spark, sf_dir):
    """All events of the busiest admission."""
    events = wide(spark, sf_dir)
    busiest = events.groupBy("hadm_id").count().orderBy(F.desc("count"), "hadm_id").first()[0]
    return EventProfile(events).timeline(busiest)


@query("clean_numeric", """
SELECT event_id, round(CASE event_type
    WHEN 'view' THEN value * 1000
    WHEN 'click' THEN (floor(value) + floor(value) + 3) / 2
    WHEN 'signup' THEN -value
    WHEN 'error' THEN NULL
    ELSE floor(value) END, 6) AS cleaned
FROM events
""")
def clean_numeric(spark, sf_dir):
    """Numbers spelled with thousands commas, as ranges, signed, as junk and plainly."""
    kind, value = F.col("event_type"), F.col("value")
    whole = F.floor("value").cast("string")
    messy = (
        F.when(kind == "view", F.format_number(value * 1000, 2))
        .when(kind == "click", F.concat(whole, F.lit(" - "), (F.floor("value") + 3).cast("string")))
        .when(kind == "signup", F.concat(F.lit("-"), F.format_number(value, 2)))
        .when(kind == "error", F.lit(" - "))
        .otherwise(whole)
    )
    events = table(spark, sf_dir, "events").select("event_id", messy.alias("cleaned"))
    return clean_numbers(events, ["cleaned"]).withColumn("cleaned", F.round("cleaned", 6))


@query("strict_cast", """
SELECT o_orderkey, CAST(o_orderkey % 60000 AS INTEGER) AS small, CAST(o_orderdate AS DATE) AS day, o_orderdate AS moment,
       o_orderstatus = 'F' AS flag, round(CAST(CAST(CAST(o_totalprice AS VARCHAR) AS FLOAT) AS DOUBLE), 1) AS price
FROM orders
""")
def strict_cast(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 60000).cast("string").alias("small"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("moment"),
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("flag"),
        F.col("o_totalprice").cast("string").alias("price"),
    )
    typed = cast_columns(
        text, {"small": "UInt", "day": "Date", "moment": "DateTime", "flag": "Boolean", "price": "Float"}
    )
    return typed.withColumn("price", F.round(F.col("price").cast("double"), 1))


@query("event_wide", """
SELECT 'event' AS event_type, user_id AS patient_id, ts AS timestamp, value AS "event/value", NULL::DOUBLE AS "order/price",
       CAST(user_id * 100 + weekofyear(ts) AS VARCHAR) AS hadm_id
FROM events
UNION ALL
SELECT 'order', o_custkey, o_orderdate, NULL, o_totalprice, o_orderpriority FROM orders
""")
def event_wide(spark, sf_dir):
    """Two tables stacked into one sparse table with one admission column."""
    events = table(spark, sf_dir, "events").select(
        F.lit("event").alias("event_type"),
        F.col("user_id").alias("patient_id"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("event/value"),
        visit_id("user_id", "ts").cast("string").alias("event/hadm_id"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.lit("order").alias("event_type"),
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("order/price"),
        F.col("o_orderpriority").alias("order/hadm_id"),
    )
    return unify_visit(events.unionByName(orders, allowMissingColumns=True))


@query("describe_codes", """
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS "c/icd_code", CAST(n_regionkey AS VARCHAR) AS "c/icd_version",
       CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS "c/description"
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def describe_codes(spark, sf_dir):
    """Nation names by (region, nation); every second nation is not in the dictionary."""
    nation = table(spark, sf_dir, "nation")
    coded = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.col("c_nationkey").cast("string").alias("c/icd_code"),
        F.col("n_regionkey").cast("string").alias("c/icd_version"),
    )
    dictionary = nation.filter("n_nationkey % 2 = 0").select(
        F.col("n_nationkey").alias("icd_code"),
        F.col("n_regionkey").alias("icd_version"),
        F.col("n_name").alias("long_title"),
    )
    return describe_coded(coded, dictionary, "c")


@query("describe_items", """
SELECT l_orderkey, l_linenumber, p_name AS "l/description" FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
""")
def describe_part_items(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("l/itemid")
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"))
    return describe_items(lines, parts, "l")
