"""Spelling variants against words counted and compared by hand."""

import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.conftest import awkward_texts
from tidemark.llm.spelling import corpus_words, near_words, spelling_variants


def words_by_hand(rows, shortest=5, fewest=3, drop_one_in=None):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_one_in and h % drop_one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= fewest}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def variants_by_hand(counts, factor=2):
    near = {w: [x for x in counts if x != w and abs(len(x) - len(w)) < 2 and one_edit(x, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts[form[w]] if form[w] else -1) for w, n in counts.items())


def variants(spark, counts, **options):
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    found = spelling_variants(table, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in found)


def alike_words(seed, n, letters="abé", longest=9):
    pick = random.Random(seed)
    return {"".join(pick.choice(letters) for _ in range(pick.randrange(5, longest))): pick.randrange(3, 60) for _ in range(n)}


@pytest.mark.parametrize("most_words", [1, 6, 20_000])
def test_near_words(spark, most_words):
    """Dense words, in partitions split as far as they can be, now and then, or not at all; each pair once."""
    counts = {**alike_words(1, 150), **alike_words(2, 20, "xyz", 30), "aaaaa": 5, "aaaaaa": 11, "aaaaaaa": 4, "aabaa": 9}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = sorted(tuple(sorted((r.word, r.other))) for r in near_words(table, most_words).collect())
    assert got == sorted((a, b) for a in counts for b in counts if a < b and abs(len(a) - len(b)) < 2 and one_edit(a, b))


def test_short_words(spark):
    """Words of two symbols have nothing to split."""
    counts = {a + b: 3 for a in "abc" for b in "abc"} | {"abc": 7, "abcd": 8}
    assert variants(spark, counts) == variants_by_hand(counts)


@pytest.mark.parametrize("seed", [3, 4])
def test_forms_and_roots(spark, seed):
    """Ties, forms of forms, words alone."""
    counts = {**alike_words(seed, 120, "ab"), "lonely": 3, "chainaaaa": 3, "chainaaab": 6, "chainaabb": 12, "chainabbb": 24, "chainbbbb": 48}
    assert variants(spark, counts) == variants_by_hand(counts)
    assert variants(spark, counts)[-1][2:] and ("chainaaaa", "chainaaab", "chainbbbb", 3, 1, 6) in variants(spark, counts)


def test_words_of_documents(spark, awkward):
    rows = awkward_texts()
    for options in ({}, {"drop_one_in": 3}, {"shortest": 1, "fewest": 1, "drop_one_in": 2}):
        got = {r.word: r.n for r in corpus_words(awkward, **options).collect()}
        want = words_by_hand(rows, **options)
        # Deleting the only symbol leaves no word.
        assert got == {w: n for w, n in want.items() if w}


def test_letters(spark):
    """Capitals beyond ASCII stay, other scripts and half characters end a word, the sign of times is in the range."""
    texts = ["ÀBCDE àbcde ÀBCDE ÀBCDE", "×÷abc Āabcde ÿÿÿÿÿ漢ÿÿÿÿÿ ÿÿÿÿÿ", "abc¿defgh abcãdefghĀ", "×÷abc ×÷ABC", "x" * 100_000 + " " + "y" * 7]
    rows = [(i, t) for i, t in enumerate(texts)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.word: r.n for r in corpus_words(frame, fewest=2, drop_one_in=5).collect()}
    assert got == words_by_hand(rows, fewest=2, drop_one_in=5)


def test_nothing(spark, no_documents):
    assert corpus_words(no_documents).count() == 0
    assert spelling_variants(corpus_words(no_documents)).count() == 0
