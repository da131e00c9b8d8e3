"""Vocabulary, tokens, sequences, landmarks on sequences, packed batches, embedding sums.

The vocabulary is read off the events: a code per event type, a code per event type and number,
value bins for views, texts for clicks.
"""

from pyspark.sql import functions as F

from catalog.base import CODED, DIAGNOSED, GRID, block_rows, code_of_event, coded_events, query, table, with_sql
from catalog.cohort import labels
from tidemark.operators import concepts, sequences, tokens
from tidemark.operators.blocks import number_rows
from tidemark.operators.ordinals import number_events
from tidemark.session import cut_lineage

LENGTH, STRIDE = 16, 8
AGE_MEAN, AGE_STD = 20000.0, 3000.0
_UNUSED_ENTRIES = 5
_BATCH = 4


def entries(spark, sf_dir):
    """``index, code, text, type, val_start, val_end, weight`` of every candidate token."""
    seen = table(spark, sf_dir, "events").select("event_type", code_of_event().alias("code"))
    codes = seen.select("event_type", "code").distinct()
    plain = codes.select("code").unionByName(seen.select(F.col("event_type").alias("code")).distinct())
    edges = F.array(*[
        F.struct(F.lit(low).alias("val_start"), F.lit(high).alias("val_end"))
        for low, high in ((-1e300, 20.0), (20.0, 60.0), (60.0, 1e300))
    ])
    bins = codes.filter("event_type = 'view' AND code < 'view/5'").select("code", F.inline(edges))
    texts = codes.filter("event_type = 'click'").select("code", F.lit("high").alias("text"))
    stacked = (
        plain.withColumn("type", F.lit(0))
        .unionByName(bins.withColumn("type", F.lit(1)), allowMissingColumns=True)
        .unionByName(texts.withColumn("type", F.lit(2)), allowMissingColumns=True)
        .withColumn("weight", -F.length("code").cast("double") / 10)
    )
    return number_rows(stacked, [], ["type", "code", "val_start", "text"], "index")


def vocabulary(spark, sf_dir, unused=0):
    listed = cut_lineage(entries(spark, sf_dir))
    return concepts.load_vocabulary(listed, listed.count() - unused)


def closure(spark, sf_dir):
    codes = table(spark, sf_dir, "events").select("event_type", code_of_event().alias("code")).distinct()
    return codes.select("code", F.explode(F.array("code", "event_type", F.lit("ANY"))).alias("ancestor")).unionByName(
        codes.select(
            F.col("event_type").alias("code"), F.explode(F.array("event_type", F.lit("ANY"))).alias("ancestor")
        ).distinct()
    )


VOCABULARY = """
codes AS (SELECT DISTINCT event_type, event_type || '/' || (props ->> '$.k') AS code FROM events),
candidates AS (
  SELECT code, 0 AS type, NULL::DOUBLE AS val_start, NULL::DOUBLE AS val_end, NULL AS text FROM codes
  UNION ALL SELECT DISTINCT event_type, 0, NULL, NULL, NULL FROM codes
  UNION ALL SELECT code, 1, b.lo, b.hi, NULL FROM codes
    CROSS JOIN (VALUES (-1e300, 20.0::DOUBLE), (20.0, 60.0), (60.0, 1e300)) b(lo, hi)
    WHERE event_type = 'view' AND code < 'view/5'
  UNION ALL SELECT code, 2, NULL, NULL, 'high' FROM codes WHERE event_type = 'click'),
entries AS (
  SELECT *, row_number() OVER (ORDER BY type, code, val_start, text) - 1 AS index, -length(code) / 10.0 AS weight
  FROM candidates),
vocab AS (SELECT * FROM entries),
closure AS (
  SELECT code, unnest([code, event_type, 'ANY']) AS ancestor FROM codes
  UNION SELECT event_type, unnest([event_type, 'ANY']) FROM codes),
expansion AS (
  SELECT index, index AS token FROM vocab
  UNION SELECT v.index, a.index FROM vocab v JOIN closure c ON c.code = v.code
    JOIN vocab a ON a.code = c.ancestor AND a.type = 0 WHERE v.type = 0)
"""

LEAVES = """
leaves AS (
  SELECT c.*, coalesce(b.index, t.index, p.index) AS index
  FROM coded c
  LEFT JOIN vocab b ON b.type = 1 AND b.code = c.code AND c.numeric_value >= b.val_start
       AND c.numeric_value < b.val_end
  LEFT JOIN vocab t ON t.type = 2 AND t.code = c.code AND t.text = c.text_value
  LEFT JOIN vocab p ON p.type = 0 AND p.code = c.code
  WHERE coalesce(b.index, t.index, p.index) IS NOT NULL)
"""

# Chunk c of a timeline exists if it is the first or the one before it does not reach the end.
CHUNKS = """
placed AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY time, ordinal) - 1 AS p,
         count(*) OVER (PARTITION BY subject_id) AS n
  FROM leaves),
births AS (SELECT subject_id, min(time) AS birth FROM coded WHERE code = 'MEDS_BIRTH' GROUP BY ALL),
cells AS (
  SELECT c.*, birth, p - chunk * 8 AS position,
         dense_rank() OVER (ORDER BY subject_id, chunk) - 1 AS sequence_id,
         date_sub('minute', birth, time) / 1440.0::DOUBLE AS age
  FROM (SELECT *, unnest([p // 8 - 1, p // 8]) AS chunk FROM placed) c JOIN births USING (subject_id)
  WHERE chunk = 0 OR chunk > 0 AND (chunk - 1) * 8 + 16 < n),
landmarks AS (
  SELECT l.subject_id, l.prediction_time, l.boolean_value, e.p
  FROM labelled l ASOF JOIN placed e ON l.subject_id = e.subject_id AND l.prediction_time >= e.time),
on_sequences AS (
  SELECT l.subject_id, arg_max(c.sequence_id, c.position) AS sequence_id, max(c.position) AS position,
         l.prediction_time, l.boolean_value
  FROM landmarks l JOIN cells c ON c.subject_id = l.subject_id AND c.p = l.p
  GROUP BY l.subject_id, l.prediction_time, l.boolean_value)
"""

PACKED = """
shape AS (
  SELECT *, CAST(2 ** ceil(log2(max(longest) OVER (PARTITION BY batch))) AS BIGINT) AS seq_len FROM (
    SELECT sequence_id, sequence_id // 4 AS batch, sequence_id % 4 AS row, count(*) AS longest
    FROM cells GROUP BY ALL))
"""


@query("bin_tokens", with_sql(CODED, VOCABULARY) + """
SELECT c.ordinal, b.index FROM coded c JOIN vocab b
ON b.type = 1 AND b.code = c.code AND c.numeric_value >= b.val_start AND c.numeric_value < b.val_end
""")
def bin_tokens(spark, sf_dir):
    """Value bins alone."""
    full = vocabulary(spark, sf_dir)
    only_bins = full._replace(codes=full.codes.filter("false"), texts=full.texts.filter("false"))
    return tokens.leaf_tokens(coded_events(spark, sf_dir), only_bins).select("ordinal", "index")


@query("vocabulary_weights", with_sql(VOCABULARY) + """
SELECT code, CAST(min(weight) AS DOUBLE) AS weight FROM vocab
WHERE index < (SELECT count(*) FROM entries) - 5 GROUP BY code
""")
def vocabulary_weights(spark, sf_dir):
    return vocabulary(spark, sf_dir, _UNUSED_ENTRIES).tokens


@query("bin_faults", """
WITH b AS (
  SELECT event_type, user_id, min(value) AS lo, round(avg(value), 3) AS mid, max(value) AS hi, count(*) % 2 AS odd
  FROM events GROUP BY event_type, user_id HAVING count(*) > 2)
SELECT event_type || '/' || user_id AS code, lo AS val_start, mid AS val_end, mid + 1 AS next_start
FROM b WHERE odd = 1
""")
def bin_faults(spark, sf_dir):
    """Two bins per user and event type; those of odd counts leave a gap."""
    ranges = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(
        F.min("value").alias("lo"), F.round(F.avg("value"), 3).alias("mid"), F.max("value").alias("hi"),
        F.count(F.lit(1)).alias("n"),
    ).filter("n > 2")
    code = F.concat("event_type", F.lit("/"), "user_id").alias("code")
    # Both bins come from one row: a mean worked out twice may be rounded to either side, as the order of its sum has it.
    lower = F.struct(F.col("lo").alias("val_start"), F.col("mid").alias("val_end"), F.lit(0).alias("index"))
    upper = F.struct(
        (F.col("mid") + F.col("n") % 2).alias("val_start"), (F.col("hi") + 1).alias("val_end"), F.lit(1).alias("index")
    )
    bins = ranges.select(code, F.inline(F.array(lower, upper)))
    return concepts.bin_faults(bins).select(
        "code", "val_start", "val_end", "next_start"
    )


@query("event_ordinals", with_sql(CODED) + """
SELECT row_number() OVER (ORDER BY subject_id NULLS FIRST, time NULLS FIRST, code IS DISTINCT FROM 'MEDS_BIRTH',
         code NULLS FIRST, "end" NULLS FIRST, numeric_value NULLS FIRST, text_value NULLS FIRST,
         visit_id NULLS FIRST) - 1 AS number,
       subject_id, time, code, visit_id, text_value
FROM coded
""")
def event_ordinals(spark, sf_dir):
    """Every coded event with its place in one order of all of them, made of its own columns."""
    numbered = number_events(coded_events(spark, sf_dir).drop("ordinal"), "number")
    return numbered.select("number", "subject_id", "time", "code", "visit_id", "text_value")


@query("leaf_tokens", with_sql(CODED, VOCABULARY, LEAVES) + "SELECT ordinal, subject_id, index FROM leaves")
def leaf_tokens(spark, sf_dir):
    found = tokens.leaf_tokens(coded_events(spark, sf_dir), vocabulary(spark, sf_dir))
    return found.select("ordinal", "subject_id", "index")


@query("ancestor_expansion", with_sql(VOCABULARY) + "SELECT index, token FROM expansion")
def ancestor_expansion(spark, sf_dir):
    return tokens.ancestor_expansion(vocabulary(spark, sf_dir), closure(spark, sf_dir))


@query("token_fanout", with_sql(CODED, VOCABULARY, LEAVES) + """
SELECT token, ordinal AS position FROM leaves JOIN expansion USING (index)
""")
def token_fanout(spark, sf_dir):
    words = vocabulary(spark, sf_dir)
    found = tokens.leaf_tokens(coded_events(spark, sf_dir), words)
    expansion = cut_lineage(tokens.ancestor_expansion(words, closure(spark, sf_dir)))
    return tokens.expand_tokens(found.withColumnRenamed("ordinal", "position"), expansion)


@query("birth_times", with_sql(CODED) + """
SELECT subject_id, min(time) AS birth FROM coded WHERE code = 'MEDS_BIRTH' GROUP BY ALL
""")
def birth_times(spark, sf_dir):
    return sequences.birth_times(coded_events(spark, sf_dir))


@query("restrict_to_labelled", with_sql(CODED, DIAGNOSED, GRID) + """
SELECT c.subject_id, c.ordinal, c.code FROM coded c
JOIN (SELECT subject_id, max(prediction_time) AS last FROM labelled GROUP BY ALL) l
  ON l.subject_id = c.subject_id AND c.time <= l.last
""")
def restrict_to_labelled(spark, sf_dir):
    kept = sequences.until_last_landmark(coded_events(spark, sf_dir), labels(spark, sf_dir), ("time", "ordinal"))
    return kept.select("subject_id", "ordinal", "code")


def chunked(spark, sf_dir, rows_per_block=None, words=None):
    coded = coded_events(spark, sf_dir)
    found = tokens.leaf_tokens(coded, words or vocabulary(spark, sf_dir))
    return sequences.chunk_timelines(
        found, sequences.birth_times(coded), length=LENGTH, stride=STRIDE, age_mean=AGE_MEAN,
        age_std=AGE_STD, ordinal="ordinal", rows_per_block=rows_per_block,
    )


_CELLS_SQL = with_sql(CODED, DIAGNOSED, GRID, VOCABULARY, LEAVES, CHUNKS) + """
SELECT subject_id, sequence_id, position, p AS subject_position, index, time,
       round(CAST(CAST(age AS FLOAT) AS DOUBLE), 2) AS age,
       round(CAST(CAST((age - 20000) / 3000 AS FLOAT) AS DOUBLE), 5) AS normed_age
FROM cells
"""


def _rounded_ages(df):
    return df.withColumns({
        "age": F.round(F.col("age").cast("double"), 2),
        "normed_age": F.round(F.col("normed_age").cast("double"), 5),
    })


@query("chunk_timeline", _CELLS_SQL)
def chunk_timeline(spark, sf_dir):
    return _rounded_ages(chunked(spark, sf_dir))


@query("chunk_timeline_split", _CELLS_SQL)
def chunk_timeline_split(spark, sf_dir):
    """The same with the subjects cut into about five hundred blocks in all."""
    small = block_rows(table(spark, sf_dir, "events"), 500)
    return _rounded_ages(chunked(spark, sf_dir, rows_per_block=small))


@query("place_labels", with_sql(CODED, DIAGNOSED, GRID, VOCABULARY, LEAVES, CHUNKS) + "SELECT * FROM on_sequences")
def place_labels(spark, sf_dir):
    cells = cut_lineage(chunked(spark, sf_dir))
    return sequences.place_landmarks(cells, cut_lineage(labels(spark, sf_dir)))


def packed(spark, sf_dir, placing=True, expanding=True):
    """All batches from one build; what a query does not ask for is not worked out beforehand."""
    words = vocabulary(spark, sf_dir)
    cells = chunked(spark, sf_dir, words=words)
    if placing:
        # Labels are placed on the cells, which are packed as well.
        cells = cut_lineage(cells)
        placed = cut_lineage(sequences.place_landmarks(cells, cut_lineage(labels(spark, sf_dir))))
    else:
        placed = spark.createDataFrame([], "sequence_id bigint, position bigint, boolean_value boolean")
    expansion = cut_lineage(tokens.ancestor_expansion(words, closure(spark, sf_dir))) if expanding else None
    return sequences.pack_batches(cells, placed, expansion, _BATCH, check=placing)


@query("pack_sequences", with_sql(CODED, DIAGNOSED, GRID, VOCABULARY, LEAVES, CHUNKS, PACKED) + """
SELECT s.batch, s.row, s.sequence_id, s.seq_len, g.position, c.p IS NOT NULL AS valid,
       coalesce(round(CAST(CAST(age AS FLOAT) AS DOUBLE), 2), 0) AS age
FROM shape s JOIN (SELECT unnest(range(0, 16)) AS position) g ON g.position < s.seq_len
LEFT JOIN cells c ON c.sequence_id = s.sequence_id AND c.position = g.position
""")
def pack_sequences(spark, sf_dir):
    """The padded arrays, one row per slot."""
    grids = packed(spark, sf_dir, placing=False, expanding=False).sequences
    slots = grids.select(
        "batch", "row", "sequence_id", "seq_len",
        F.posexplode(F.arrays_zip("ages", "valid_tokens")).alias("position", "slot"),
    )
    return slots.select(
        "batch", "row", "sequence_id", "seq_len", "position", F.col("slot.valid_tokens").alias("valid"),
        F.round(F.col("slot.ages").cast("double"), 2).alias("age"),
    )


@query("pack_pairs", with_sql(CODED, DIAGNOSED, GRID, VOCABULARY, LEAVES, CHUNKS, PACKED) + """
SELECT batch, token, row * seq_len + position AS flat
FROM cells JOIN shape USING (sequence_id) JOIN expansion ON expansion.index = cells.index
""")
def pack_pairs(spark, sf_dir):
    return packed(spark, sf_dir, placing=False).pairs


@query("pack_labels", with_sql(CODED, DIAGNOSED, GRID, VOCABULARY, LEAVES, CHUNKS, PACKED) + """
SELECT batch, row * seq_len + position AS flat, CAST(boolean_value AS DOUBLE) AS label
FROM on_sequences JOIN shape USING (sequence_id)
""")
def pack_labels(spark, sf_dir):
    return packed(spark, sf_dir, expanding=False).labels.withColumn("label", F.col("label").cast("double"))


@query("packed_batches", with_sql(CODED, DIAGNOSED, GRID, VOCABULARY, LEAVES, CHUNKS, PACKED) + """
, grids AS (SELECT batch, count(*) AS n_sequences, max(seq_len) AS seq_len, sum(longest) AS n_cells FROM shape GROUP BY batch),
pairs AS (
  SELECT batch, count(*) AS n_pairs, sum((row * seq_len + position) * 7 + token) AS pairs_sum
  FROM cells JOIN shape USING (sequence_id) JOIN expansion ON expansion.index = cells.index GROUP BY batch),
marks AS (
  SELECT batch, count(*) AS n_labels, sum(row * seq_len + position) AS labels_sum, count(*) FILTER (boolean_value) AS n_true
  FROM on_sequences JOIN shape USING (sequence_id) GROUP BY batch)
SELECT batch, n_sequences, seq_len, CAST(n_cells AS BIGINT) AS n_cells, coalesce(n_pairs, 0) AS n_pairs,
       CAST(coalesce(pairs_sum, 0) AS BIGINT) AS pairs_sum, coalesce(n_labels, 0) AS n_labels,
       CAST(coalesce(labels_sum, 0) AS BIGINT) AS labels_sum, coalesce(n_true, 0) AS n_true
FROM grids LEFT JOIN pairs USING (batch) LEFT JOIN marks USING (batch)
""")
def packed_batches(spark, sf_dir):
    """What each batch holds: rows, pairs and labels, all three out of one build."""
    built = packed(spark, sf_dir)
    grids = built.sequences.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_sequences"), F.max("seq_len").alias("seq_len"),
        F.sum(F.size(F.filter("valid_tokens", lambda v: v))).alias("n_cells"),
    )
    pairs = built.pairs.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("flat") * 7 + F.col("token")).alias("pairs_sum")
    )
    marks = built.labels.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_labels"), F.sum("flat").alias("labels_sum"), F.count_if(F.col("label") == 1).alias("n_true")
    )
    return grids.join(pairs, "batch", "left").join(marks, "batch", "left").fillna(0)


@query("embedding_sum", """
SELECT user_id AS position, dim - 1 AS dim, round(sum(v), 5) AS total FROM (
  SELECT e.user_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim
  FROM events e LEFT JOIN embeddings m ON m.vec_id = CAST(e.props ->> '$.k' AS BIGINT))
GROUP BY ALL
""")
def embedding_sum(spark, sf_dir):
    """Sum, per user, of the embeddings the numbers in props point at."""
    pairs = table(spark, sf_dir, "events").select(
        F.get_json_object("props", "$.k").cast("bigint").alias("token"), F.col("user_id").alias("position")
    )
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), "embedding")
    dims = rows.select(F.size("embedding")).first()[0]
    summed = tokens.sum_embeddings(pairs, rows, dims)
    return summed.select("position", F.posexplode("vector").alias("dim", "total")).withColumn(
        "total", F.round("total", 5)
    )
