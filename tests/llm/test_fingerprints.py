"""Merkle trees of documents against trees built by hand, and neighbours across blocks."""

import re
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import awkward_texts, made_up
from tidemark.llm.common import keyed
from tidemark.llm.fingerprints import (
    as_text,
    changed_paragraphs,
    distinct_leaves,
    fingerprint_documents,
    likeness,
    seated_in_blocks,
    with_next,
    with_tree,
)


def digest(text):
    return md5(text.encode()).hexdigest()


def tree_by_hand(text):
    paragraphs = []
    for line in text.split("\n"):
        parts = re.findall("(?s).*?[.!?] |.+", line)
        leaves = [int(digest(s)[:10], 16) * 2**23 + len(s) for s in parts]
        paragraphs.append((digest("p" + "".join(map(digest, parts))), leaves))
    sections, run = [], []
    for i, p in enumerate(paragraphs):
        run.append(p)
        if p[0][0] in "01" or i == len(paragraphs) - 1:
            sections.append((digest("s" + "".join(d for d, _ in run)), run))
            run = []
    return digest("r" + "".join(d for d, _ in sections)), sections


def text_by_hand(tree):
    root, sections = tree
    return root + "".join(
        "/" + d[:8] + "".join("." + p[:8] + "".join(f"-{x:x}" for x in leaves) for p, leaves in run) for d, run in sections
    )


def likeness_by_hand(one, other):
    if one[0] == other[0]:
        return 1.0
    a, b = ({x for _, run in t[1] for _, leaves in run for x in leaves} for t in (one, other))
    weight = lambda xs: sum(x % 2**23 for x in xs)
    return weight(a & b) * 2.0 / (weight(a) + weight(b) + 1)


def test_awkward_documents(spark, awkward):
    """Ties, repeated rows, nulls, empty and long texts, clashing columns: each row meets its neighbour."""
    for size in (1, 4, None):
        found = fingerprint_documents(awkward, rows_per_block=size)
        got = [(r.doc_id, r.text, r.next_text, r.whole, r.near) for r in found.select(
            "doc_id", "text", "next_text", as_text(F.col("tree")).alias("whole"),
            likeness(F.col("root"), F.col("leaves"), F.col("next_root"), F.col("next_leaves")).alias("near"),
        ).collect()]
        hashes = dict(awkward.select(F.coalesce("text", F.lit("")), F.xxhash64("text")).distinct().collect())
        rows = sorted(((i is not None, i or 0, hashes[t or ""]), i, t or "") for i, t in awkward_texts())[::-1]
        want = [(i, t, n) for (_, i, t), (_, _, n) in zip(rows, rows[1:] + rows[:1])]
        assert sorted(got_row[:3] for got_row in got if got_row[0] is not None) == sorted(w for w in want if w[0] is not None)
        assert [g[:3] for g in got if g[0] is None] == [w for w in want if w[0] is None]
        for _, text, other, whole, near in got:
            assert whole == text_by_hand(tree_by_hand(text)) and near == likeness_by_hand(tree_by_hand(text), tree_by_hand(other))


@pytest.mark.parametrize("size", [1, 7, 400])
def test_neighbours_over_blocks(spark, size):
    """A third of all rows share an id; some rows repeat."""
    ids = [*range(0, 600, 3), *[50] * 100, -5, 10**12]
    rows = spark.createDataFrame([(i, f"t{n % 97}") for n, i in enumerate(ids)], "doc_id long, text string").repartition(6)
    seated = seated_in_blocks(keyed(rows, "doc_id", "text"), size).cache()
    if size < 100:
        assert seated.select("_block").distinct().count() > 200 / size / 4
    got = [tuple(r) for r in with_next(seated, ["doc", "th"]).select("doc", "th", "next_doc", "next_th").collect()]
    order = sorted((tuple(r) for r in keyed(rows, "doc_id", "text").select("doc", "th").collect()), reverse=True)
    assert sorted(got) == sorted((*a, *b) for a, b in zip(order, order[1:] + order[:1]))


def test_edits_are_found(spark):
    """One changed sentence of many paragraphs: that paragraph, and a likeness near one."""
    lines = [f"{made_up(n, 12)}. {made_up(100 + n, 9)}! {made_up(200 + n, 5)}" for n in range(40)]
    edited = [*lines[:17], lines[17].replace("! ", "! new "), *lines[18:25], "an added line", *lines[25:]]
    frame = with_tree(with_tree(spark.createDataFrame([("\n".join(lines), "\n".join(edited))], "a string, b string"), "a", "x"), "b", "y")
    there, back, near, same = frame.select(
        changed_paragraphs(F.col("x"), F.col("y")), changed_paragraphs(F.col("y"), F.col("x")),
        likeness(F.col("x.root"), distinct_leaves(F.col("x")), F.col("y.root"), distinct_leaves(F.col("y"))),
        F.size(changed_paragraphs(F.col("x"), F.col("x"))),
    ).first()
    paragraph = lambda t: [p for _, run in tree_by_hand(t)[1] for p, _ in run]
    assert there == paragraph(lines[17]) and back == [*paragraph(edited[17]), *paragraph("an added line")]
    assert 0.9 < near < 1 and same == 0


def test_no_documents(no_documents, spark):
    assert fingerprint_documents(no_documents).count() == 0
    alone = fingerprint_documents(spark.createDataFrame([(3, "one")], "doc_id long, text string")).first()
    assert (alone.doc_id, alone.next_text, alone.next_root) == (3, "one", alone.root)
