"""The registered queries over the smallest given tables, against plain versions of what they return."""

import re
import zlib
from hashlib import sha256
from html.parser import HTMLParser
from itertools import combinations
from pathlib import Path

import pyarrow.dataset as ds
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from tests.llm.test_passages import hits_by_hand, kept_by_hand
from tidemark.llm.licences import canonical, known_licences
from tidemark.llm.pseudonyms import replace_personal_data
from tidemark.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the given tables are not here")


def digest(text):
    return sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def given():
    def rows(name, *columns):
        return [tuple(r.values()) for r in ds.dataset(f"{SF_DIR}/{name}.parquet").to_table(columns=list(columns)).to_pylist()]

    return rows


def answers(spark, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, SF_DIR).collect())


def test_op1(spark, given):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in given("documents", "doc_id", "text")}
    placed, seen = {}, {i: 0 for i in ids}
    for doc, start, length, crc, total, sequence, offset in answers(spark, "op1_packing"):
        assert start == seen[doc] and total == len(ids[doc])
        seen[doc] += length
        assert crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[doc][start:start + length]))
        placed.setdefault(sequence, []).append((offset, length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for lot in placed.values():
        lot.sort()
        assert [o for o, _ in lot] == [sum(n for _, n in lot[:i]) for i in range(len(lot))] and sum(n for _, n in lot) <= 2048
    assert sum(seen.values()) > 0.97 * 2048 * len(placed)


def test_op2(spark, given):
    want = [(i, n, gone, digest(text)) for i, n, gone, text in kept_by_hand(given("documents", "doc_id", "text"), 20)]
    assert answers(spark, "op2_substring_dedup") == sorted(want)


def test_op3_counts(spark, given):
    """The base columns of every document; the verdict keeps nothing that fails the base rules."""
    want = []
    for i, t in given("documents", "doc_id", "text"):
        words, lines, seen, windows = WORD.findall(t), t.split("\n"), set(), {}
        repeated = 0
        for line in lines:
            repeated += bool(WORD.search(line)) and line in seen
            seen.add(line)
        for w in range(len(words) - 7):
            windows.setdefault(tuple(words[w:w + 8]), []).append(w)
        covered = {at + j for places in windows.values() if len(places) > 1 for at in places for j in range(8)}
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(covered), failed))
    got = answers(spark, "op3_quality_rules")
    assert [r[:7] for r in got] == sorted(want)
    assert not any(failed and kept for *_, failed, kept, _ in got)


def test_op5(spark, given):
    """Fingerprints of all documents from their definition, all pairs of them compared."""
    prints = {}
    for i, t in given("documents", "doc_id", "text"):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[w:w + 3]) for w in range(max(len(words) - 2, min(len(words), 1)))]
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    assert links
    assert answers(spark, "op5_simhash_near_dedup") == sorted((i, f"{fp:016x}", least[i]) for i, fp in prints.items())


def test_op4(spark, given):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = []
    for i, t in given("documents", "doc_id", "text"):
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        counts = [sum(k == kind for _, k, _ in found) for kind in range(3)]
        want.append((i, *counts, digest(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found)))))
    assert [r[:5] for r in answers(spark, "op4_secret_scan")] == sorted(want)


def test_op6(spark, given):
    found = hits_by_hand(given("documents", "doc_id", "text"), given("benchmark", "item_id", "text"))
    want = [(i, n, hit, len(items), digest(",".join(sorted(map(str, items)))), hit > 0) for i, n, hit, items in found]
    assert answers(spark, "op6_benchmark_decontamination") == sorted(want)


def test_op7(spark, given):
    """Every run of whole lines of every document, put in canonical form and looked up."""
    forms: dict = {}
    for licence, text in known_licences(spark).collect():
        forms.setdefault(tuple(canonical(text).split()), set()).add(licence)
    longest = max(map(len, forms))
    want = []
    for i, t in given("documents", "doc_id", "text"):
        lines = [x for x in (canonical(line).split() for line in (t or "").split("\n")) if x]
        found: set = set()
        for a in range(len(lines)):
            run: list = []
            for line in lines[a:]:
                run += line
                if len(run) > longest:
                    break
                found |= forms.get(tuple(run), set())
        whole = forms.get(tuple(w for line in lines for w in line), set())
        want.append((i, ",".join(sorted(whole)), ",".join(sorted(found)), len(found)))
    assert any(n for *_, n in want)
    assert answers(spark, "op7_license_scan") == sorted(want)


def test_op8(spark, given):
    """Only what the spans name changes, and the same key undoes it, on every document."""
    texts = dict(given("documents", "doc_id", "text"))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    new = replace_personal_data(docs, b"a key").select("doc_id", "text", "spans")
    rows = new.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and any(r.spans for r in rows)
    for r in rows:
        text, at, form = texts[r.doc_id], 0, ""
        for span in sorted(r.spans, key=lambda x: x.start):
            # The parts of an address are numbers up to 255, of any length; all else keeps its length.
            value = r"\d+(?:\.\d+){3}" if span.kind == "ip" else f".{{{span.end - span.start}}}"
            form += re.escape(text[at:span.start]) + value
            at = span.end
        assert re.fullmatch(form + re.escape(text[at:]), r.text, re.S)
    back = replace_personal_data(new.select("doc_id", "text"), b"a key", back=True)
    assert {r.doc_id: r.text for r in back.collect()} == texts


class Article(HTMLParser):
    """The text inside <article>, with a blank where a block or line ends. The given pages mark nothing else in it."""

    def __init__(self, html):
        super().__init__()
        self.inside, self.found = False, []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.gap(tag)

    def handle_endtag(self, tag):
        self.gap(tag)
        self.inside &= tag != "article"

    def gap(self, tag):
        if tag not in ("b", "i", "em", "strong", "a", "span"):
            self.found.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.found.append(data)


def test_op10(spark, given):
    want = []
    for i, url, html in given("pages", "page_id", "url", "html"):
        text = " ".join("".join(Article(html or "").found).split())
        want.append((i, url, text, len(text)))
    assert answers(spark, "op10_html_extraction") == sorted(want)


@pytest.mark.parametrize("name,table", [
    ("op3_quality_rules", "documents"), ("op5_simhash_near_dedup", "documents"), ("op7_license_scan", "documents"),
    ("op8_pii_pseudonyms", "documents"), ("op9_line_dedup", "documents"), ("op10_html_extraction", "pages"),
])
def test_one_row_per_row(spark, given, name, table):
    key = {"pages": "page_id"}.get(table, "doc_id")
    assert [r[0] for r in answers(spark, name)] == sorted(r[0] for r in given(table, key))


def test_stages_keep_columns_that_clash_with_their_own(spark, tmp_path):
    """Documents with columns named like those the stages work with: each comes out with the values it went in with."""
    names = ["doc", "th", "kept_text", "row", "fp", "n_removed", "dotted.name"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF_DIR))
        assert docs.columns == columns
        assert docs.count() > 0
        for name in names:
            assert docs.filter(~F.col(f"`{name}`").eqNullSafe(F.concat(F.lit(name), "doc_id"))).isEmpty()
    plain = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain = corpus_pipeline.staged(stage(spark, plain, SF_DIR))
    assert sorted(map(tuple, docs.select("doc_id", "text").collect())) == sorted(map(tuple, plain.select("doc_id", "text").collect()))


def test_pipeline(spark, given):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    ids = {r[0] for r in given("documents", "doc_id")}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF_DIR))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        left = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids
        assert (set(left) == ids) if name == "line dedup" else len(left) >= 0.7 * len(ids), name
        ids = set(left)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).collect()} == ids
    hits = hits_by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()], given("benchmark", "item_id", "text"))
    assert not any(hit for _, _, hit, _ in hits)
