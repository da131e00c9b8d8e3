"""Rule statistics against plain counts, the forest on clear anomalies, and page extraction."""

import re
import time
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import awkward_texts, made_up
from tidemark.llm.html_text import blocks_of, extract_main_text, main_text
from tidemark.llm.quality import COUNTS, IsolationForest, judge_quality, threshold


def test_statistics(spark, awkward, no_documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = judge_quality(awkward, labels).collect()
    want = []
    for key, text in awkward_texts():
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        twice = {j for i in range(len(words) - 7) if runs[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((key, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice)))
    assert sorted(((r.doc_id, *(r[c] for c in COUNTS)) for r in rows), key=str) == sorted(want, key=str)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed)
    assert judge_quality(no_documents, labels).collect() == []


def test_forest_rejects_what_labels_call_bad(spark):
    good = [(i, made_up(i, 150)) for i in range(120)]
    bad = [(1000 + i, " ".join(f"{w}#$%&" for w in made_up(i, 150).split())) for i in range(12)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 2)] + [(1000 + i, 0) for i in range(0, 12, 2)] + [(3, None)], "doc_id long, quality int")
    kept = {r.doc_id for r in judge_quality(docs, labels).filter("kept").collect()}
    assert not any(i >= 1000 for i in kept) and len(kept) >= 115


def test_forest_and_threshold():
    rows = np.concatenate((np.random.default_rng(1).normal(size=(500, 4)), np.full((1, 4), 9.0)))
    scores = IsolationForest(rows, 50, 64, 1).score(rows)
    assert scores.argmax() == 500 and 0 < scores.min() < scores.max() < 1
    assert threshold([], 0.01) == threshold([(900, 5, 0)], 0.01) == float("inf")
    assert threshold([(900, 0, 9), (800, 1, 5), (500, 99, 1)], 0.01) == 0.8


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="post"><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use the cookies of this site, and it is for all of you to be with us.</div>{main}
<aside>The other of the things that you may like to read in the days to come.</aside><div id="comments"><p>{comment}</p></div>
<form><label>The name of the user is to be in this field</label></form><footer>&copy; x</footer>"""
PROSE = "The house of the man is on the hill, and it was seen by all of us who came there."
COMMENT = "I was there too and it was not as you say, for the hill is in the other part of the land."


def test_main_text():
    article = f"<article><h1>A &amp; B</h1><p>{PROSE}<br>Short.<p>{PROSE}&nbsp; x</article>"
    assert main_text(PAGE.format(main=article, comment=COMMENT)) == f"A & B {PROSE} Short. {PROSE} x"
    plain = f'<div class="content"><h2>Title</h2><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p><ul><li><a href="x">The link of the day is here for you</a></li></ul></div>'
    assert main_text(PAGE.format(main=plain, comment=COMMENT)) == f"Title {PROSE} Yes. {PROSE}"
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<script>") == ""
    assert main_text("<article><p>cut off &lt;b&gt; te") == "cut off <b> te"
    assert main_text(f"<article><p>{'x y ' * 50_000}</p></article>") == ("x y " * 50_000).strip()


def test_article_mark_is_no_verdict():
    links = "".join(f'<li><a href="{i}">One more page of the many that are here {i}</a></li>' for i in range(3))
    card = '<article><a href="x">A teaser of another page that you may want to read as well</a></article>'
    assert main_text(f"<body><div><p>{PROSE}</p><p>{PROSE}</p></div>{card}</body>") == f"{PROSE} {PROSE}"
    inside = f"<article><h1><a href='/'>Title</a></h1><p>{PROSE}</p><ul>{links}</ul><p>{PROSE}</p><ul>{links}<li>more</li>{links}</ul></article>"
    assert main_text(PAGE.format(main=inside, comment=COMMENT)) == f"Title {PROSE} {PROSE}"
    finnish = "Talo seisoo korkealla kukkulalla, josta näkyy koko laakso sekä kaukainen järvi metsän takana."
    other = f"<article><h1>Talo</h1><p>{finnish}</p><p>Niin.</p><p>{finnish}</p></article>"
    assert main_text(PAGE.format(main=other, comment=COMMENT)) == f"Talo {finnish} Niin. {finnish}"
    assert main_text(PAGE.format(main="<article><p>Short.</p></article>", comment=COMMENT)) == "Short."


@pytest.mark.parametrize("page", [
    "<div>" * 60_000 + "</span>" * 60_000, "<object>" * 60_000, "<script>" + "</script" * 60_000, "<head>" * 60_000, "<head>" + "</head" * 60_000,
])
def test_thousands_of_unclosed_tags_take_linear_time(page):
    begun = time.process_time()
    main_text(page)
    assert time.process_time() - begun < 10


def test_ends_of_raw_elements():
    texts = lambda page: [b.text for b in blocks_of(page)]
    assert texts("a<title>b</title >c") == ["a", "c"]
    assert texts("a<object>b<object>c</p>d") == ["abc", "d"]
    assert texts("a<script>b</script") == ["a"]
    assert texts("<head>a<body>b") == texts("<head>a</head>b") == ["b"]
    assert texts("<title>a</title") == ["a"]


def test_pages(spark):
    rows = [(1, "u", f"<article>{PROSE}</article>", "q"), (2, None, None, "q"), (2, None, None, "q"), (None, "v", "", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text) for r in extract_main_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", PROSE), (2, None, ""), (2, None, ""), (None, "v", "")], key=str)
    assert extract_main_text(pages.filter("false")).collect() == []
