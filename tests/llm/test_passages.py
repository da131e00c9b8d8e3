"""Passages that repeat, and passages of a benchmark, against plain loops over all windows."""

import random
import re

import pytest

from tests.llm.conftest import awkward_texts, made_up
from tidemark.llm.decontaminate import find_benchmark_passages
from tidemark.llm.substring_dedup import remove_repeated_passages

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def kept_by_hand(rows, length):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    words = [SPACED.findall(t or "") for _, t in rows]
    first = {}
    for i in order:
        for s in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][s:s + length]), (rows[i][0], s))
    out = []
    for (key, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s:s + length])] != (key, s):
                gone.update(range(s, s + length))
        out.append((key, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def test_awkward_documents(awkward):
    got = remove_repeated_passages(awkward).collect()
    assert in_order(got) == in_order(kept_by_hand(awkward_texts(), 20))


@pytest.mark.parametrize("seed", range(4))
def test_random_documents_of_few_words(spark, seed):
    pick = random.Random(seed)
    rows = [(i, made_up(pick.randrange(9), pick.randrange(0, 60), 2 + seed)) for i in pick.sample(range(1000), 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = remove_repeated_passages(docs, length=6 + seed, k=3).collect()
    assert in_order(got) == in_order(kept_by_hand(rows, 6 + seed))


def test_no_documents(no_documents):
    assert remove_repeated_passages(no_documents).collect() == []


def lowered(text):
    return PLAIN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def hits_by_hand(rows, items, length=10):
    windows = {}
    for item, text in items:
        w = lowered(text)
        size = min(length, len(w))
        for s in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[s:s + size]), set()).add(item)
    out = []
    for key, text in rows:
        w, hit, names = lowered(text), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s:s + size]) in windows:
                    hit.update(range(s, s + size))
                    names |= windows[tuple(w[s:s + size])]
        out.append((key, len(w), len(hit), sorted(names)))
    return out


def answers(found):
    return in_order((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in found.collect())


def test_benchmark_with_short_items_and_repeats(spark, awkward):
    passage = made_up(1, 60).split()
    items = [
        (1, " ".join(passage[10:35])), (2, " ".join(passage[20:24])), (3, "w17"), (4, None), (5, " .,! "), (6, made_up(99, 30)),
        (7, " ".join(passage[10:35])), (8, "Ünï CÖDE é"), (9, " - ".join(passage[40:49]).upper()), (1, " ".join(passage[10:35])),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert answers(find_benchmark_passages(awkward, table)) == in_order(hits_by_hand(awkward_texts(), items))


def test_joins_by_shuffle_give_the_same(spark, awkward, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.BROADCAST_BYTES", 0)
    items = [(1, made_up(1, 60)), (2, "w5 w6")]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert answers(find_benchmark_passages(awkward, table)) == in_order(hits_by_hand(awkward_texts(), items))


def test_empty_sides(spark, awkward, no_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in find_benchmark_passages(awkward, none).collect()} == {0}
    table = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert find_benchmark_passages(no_documents, table).collect() == []
