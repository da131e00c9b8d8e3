"""The operators applied to the whole given tables: one query each, and the pipeline's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import find_benchmark_passages
from tidemark.llm.fingerprints import as_text, distinct_leaves, fingerprint_documents, likeness, with_tree
from tidemark.llm.html_text import extract_main_text
from tidemark.llm.line_dedup import find_repeated_lines
from tidemark.llm.licences import find_licences, known_licences
from tidemark.llm.packing import pack_documents
from tidemark.llm.prefix_trie import continued, prefix_trie, turn_digests
from tidemark.llm.pseudonyms import replace_personal_data
from tidemark.llm.quality import COUNTS, judge_quality
from tidemark.llm.secrets import KINDS, find_secrets
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.spelling import corpus_words, spelling_variants
from tidemark.llm.substring_dedup import remove_repeated_passages

TOKENIZER = "byte_bpe_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "score")


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("strong", lambda s: s.kind == kind)).cast("long")

    def listed(spans: str):
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", names[s.kind], s.start.cast("string"), s.end.cast("string"))), ","
        )

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed("strong"), 256).alias("base_sha256"), listed("spans").alias("spans"),
    )


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licences(table(spark, sf_dir, "documents"), known_licences(spark))
    return found.select(
        "doc_id", F.array_join("whole", ",").alias("whole"), F.array_join("licences", ",").alias("licences"),
        F.size("licences").cast("long").alias("n_licences"),
    )


@query
def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is for show; whoever keeps pseudonyms passes a secret one."""
    found = replace_personal_data(table(spark, sf_dir, "documents"), b"an example, not a secret")
    spans = F.array_join(
        F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ","
    )
    return found.select("doc_id", "text", F.size("spans").cast("long").alias("n_found"), spans.alias("spans"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = find_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = continued(turn_digests(table(spark, sf_dir, "conversations")))
    return prefix_trie(turns, convs)


# CRC-32 of an ASCII text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT)),
    lambda c, b: list_reduce(
        list_prepend(xor(c, b), range(8)),
        lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

ORACLES["op11_prefix_trie"] = f"""
WITH own AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 100 AS base, {_CRC32.format("(c::VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM own)),
sized AS (
    SELECT c, base, h, least(h, (SELECT count(*) FROM own AS b WHERE b.c = convs.base)) AS taken FROM convs),
rebuilt AS (
    SELECT s.c, o.pos AS depth, o.role, o.text FROM sized AS s JOIN own AS o ON o.c = s.base AND o.pos <= s.h
    UNION ALL
    SELECT s.c, o.pos - s.h + s.taken, o.role, o.text FROM sized AS s JOIN own AS o ON o.c = s.c AND o.pos > s.h),
turns AS (
    SELECT c, depth, length(text) AS chars, count(*) OVER (PARTITION BY c) AS n,
        list(struct_pack(r := role, t := text)) OVER (
            PARTITION BY c ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path
    FROM rebuilt),
members AS (
    SELECT c, depth, chars, n, path FROM turns
    UNION ALL
    SELECT c, 0, 0, (SELECT count(*) FROM rebuilt AS r WHERE r.c = convs.c), [] FROM convs),
nodes AS (
    SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
        string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth) AS ends
    FROM members GROUP BY depth, path),
children AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
below AS (
    SELECT top.path, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved, count(*) FILTER (n.n_children = 0) AS leaves
    FROM full_nodes AS n, unnest(range(0, n.depth + 1)) AS u(d) JOIN nodes AS top ON top.path = n.path[:d] GROUP BY top.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, below.leaves AS n_leaves,
    below.saved AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_nodes AS n JOIN below USING (path)
LEFT JOIN nodes AS p ON n.depth > 0 AND p.path = n.path[:n.depth - 1]
"""


@query
def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(table(spark, sf_dir, "documents"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    parts = found.select(
        "doc_id", n.cast("long").alias("n_chars"), as_text(F.col("tree")).alias("fingerprint"), "root", "leaves",
        likeness(F.col("root"), F.col("leaves"), F.col("next_root"), F.col("next_leaves")).alias("near_next"),
        F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"),
    )
    edited = with_tree(parts, "edited", "tree").withColumn("edited_leaves", distinct_leaves(F.col("tree")))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        as_text(F.col("tree")).alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("leaves"), F.col("tree.root"), F.col("edited_leaves")).alias("near_edited"), "near_next",
    )


ORACLES["op13_document_fingerprints"] = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
paired AS (
    SELECT *, length(text) AS n, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
    FROM docs WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)),
edits AS (SELECT *, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM paired),
texts AS (SELECT DISTINCT text FROM docs UNION SELECT edited FROM edits),
sentences AS (
    SELECT text, list_transform(string_split(text, chr(10)), lambda p: list_transform(
        regexp_extract_all(p, '(?s).*?[.!?] |.+'), lambda s: struct_pack(d := md5(s), n := length(s)))) AS cut FROM texts),
paragraphs AS (
    SELECT text, list_transform(cut, lambda p: struct_pack(
        d := md5('p' || array_to_string(list_transform(p, lambda s: s.d), '')),
        leaves := list_transform(p, lambda s: ('0x' || s.d[:10])::BIGINT * 8388608 + least(s.n, 8388607)))) AS ps FROM sentences),
ended AS (
    SELECT text, ps, list_filter(range(1, len(ps) + 1), lambda i: i = len(ps) OR ps[i].d[1] IN ('0', '1')) AS ends FROM paragraphs),
runs AS (
    SELECT text, ps, list_transform(ends, lambda e, k: ps[coalesce(ends[k - 1], 0) + 1:e]) AS runs FROM ended),
sections AS (
    SELECT text, ps, list_transform(runs, lambda s: struct_pack(
        d := md5('s' || array_to_string(list_transform(s, lambda p: p.d), '')), ps := s)) AS sections FROM runs),
rooted AS (
    SELECT text, sections, md5('r' || array_to_string(list_transform(sections, lambda s: s.d), '')) AS root,
        list_distinct(flatten(list_transform(ps, lambda p: p.leaves))) AS leaves FROM sections),
trees AS (
    SELECT text, root, leaves, coalesce(list_sum(list_transform(leaves, lambda x: x & 8388607)), 0) AS weight,
        root || array_to_string(list_transform(sections, lambda s: '/' || s.d[:8] || array_to_string(
            list_transform(s.ps, lambda p: '.' || p.d[:8] || array_to_string(
                list_transform(p.leaves, lambda x: '-' || lower(to_hex(x))), '')), '')), '') AS whole FROM rooted),
common AS (
    SELECT e.*, t.whole AS fingerprint, o.whole AS edited_fingerprint, t.root, o.root AS edited_root, n.root AS next_root,
        t.weight + o.weight + 1 AS with_edited, t.weight + n.weight + 1 AS with_next,
        coalesce(list_sum(list_transform(list_intersect(t.leaves, o.leaves), lambda x: x & 8388607)), 0) AS edited_common,
        coalesce(list_sum(list_transform(list_intersect(t.leaves, n.leaves), lambda x: x & 8388607)), 0) AS next_common
    FROM edits AS e JOIN trees AS t ON t.text = e.text JOIN trees AS o ON o.text = e.edited JOIN trees AS n ON n.text = e.next_text)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
    CASE WHEN root = edited_root THEN 1.0::DOUBLE ELSE edited_common * 2.0::DOUBLE / with_edited END AS near_edited,
    CASE WHEN root = next_root THEN 1.0::DOUBLE ELSE next_common * 2.0::DOUBLE / with_next END AS near_next
FROM common
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(corpus_words(table(spark, sf_dir, "documents"), drop_one_in=97))


# CRC-32 of the UTF-8 bytes of a text.
_CRC32_UTF8 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(
        range(0, length(hex(encode({0}))) // 2), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: list_reduce(
        list_prepend(xor(c, b), range(8)),
        lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
found AS (
    SELECT doc_id, run, count(*) AS times, coalesce(doc_id::VARCHAR, '') || ':' || run AS named
    FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
summed AS (SELECT run, times, {_CRC32_UTF8.format("named")} AS h FROM found),
cut AS (
    SELECT times, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
    FROM summed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
gaps AS (
    SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
replaced AS (SELECT x.word, y.word AS other, y.n AS other_n FROM gaps AS x JOIN gaps AS y USING (i, a, b) WHERE x.word <> y.word),
shorter AS (SELECT DISTINCT g.word, g.n, w.word AS other, w.n AS other_n FROM gaps AS g JOIN words AS w ON w.word = g.a || g.b),
near AS (
    SELECT * FROM replaced UNION ALL SELECT word, other, other_n FROM shorter UNION ALL SELECT other, word, n FROM shorter),
best AS (
    SELECT word, count(*) AS n_near, max(other_n) AS most, min(encode(other)) FILTER (other_n = top) AS first
    FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 2 * w.n THEN decode(b.first) END AS form,
        CASE WHEN b.most >= 2 * w.n THEN b.most END AS form_n
    FROM words AS w LEFT JOIN best AS b USING (word)),
way AS (
    SELECT word, word AS root FROM formed
    UNION ALL SELECT way.word, f.form FROM way JOIN formed AS f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
FROM formed AS f JOIN way AS w USING (word) JOIN formed AS last ON last.word = w.root AND last.form IS NULL
"""
