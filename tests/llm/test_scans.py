"""Secrets, licences and personal data."""

import random
import re
import time

import pyarrow as pa
import pytest

from tests.llm.conftest import awkward_texts
from tidemark.llm import pseudonyms, secrets
from tidemark.llm.licences import DECLARED, KNOWN, canonical, find_licences, known_licences, runs_of_lines
from tidemark.llm.pseudonyms import Feistel, luhn, pseudonymise, replace_personal_data
from tidemark.llm.secrets import KINDS, _endpoints, _strong, _weak, find_secrets

KEY40 = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"


def spans(docs):
    return {r.doc_id: ([tuple(s) for s in r.strong], [tuple(s) for s in r.spans]) for r in find_secrets(docs).collect()}


def test_strong_patterns(spark):
    texts = [
        "é password: token: abcdefgh", 'API-KEY="abc" apikey = abcdef', "Secret=short passwd:longenough", "xAKIA" + "A" * 16 + "b AKIA123",
        "token='" + "0123456789abcdef" * 2 + "'", "0" * 23 + "g" + "f" * 24, "ſecret=abcdefgh toKen=abcdefgh", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for key, (strong, all_spans) in spans(docs).items():
        t = texts[key] or ""
        want = [(0, *m.span()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(2, *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert strong == all_spans == sorted(want, key=lambda s: (s[1], s[0]))


def test_weak_parts_count_only_together(spark):
    access = "AKIA" + "B2" * 8
    docs = spark.createDataFrame(
        [(1, KEY40), (2, f"{access} then {KEY40} at https://api.example.com/v1"), (3, f"{access}{' x' * 400} {KEY40}"),
         (4, "https://api.example.com"), (5, f"{KEY40} {KEY40} ABCD1234EFGH5678")],
        "doc_id long, text string",
    )
    names = {k: [KINDS[s[0]] for s in v[1]] for k, v in spans(docs).items()}
    assert names == {1: [], 2: ["access", "weak_key", "endpoint"], 3: ["access"], 4: [], 5: ["weak_key", "weak_key", "weak_id"]}


class Unused:
    def finditer(self, *_):
        raise AssertionError("matched against a text that cannot hold it")


def test_patterns_are_matched_only_where_they_can_be(monkeypatch):
    text = "a password and a token of some.host.locally, deadbeef and HTTPS//, in plain words".encode()
    want = (_strong(text), _weak(text))
    for name in ("ASSIGN", "ACCESS", "HEX", "WEAK_KEY", "WEAK_ID", "ADDRESS", "_LABELS"):
        monkeypatch.setattr(secrets, name, Unused())
    text = text.replace(b".locally", b" locally")
    assert want == ([], []) == (_strong(text), _weak(text))


def test_what_is_looked_for_first_loses_nothing():
    pick = random.Random(8)
    parts = [
        "password", "TOKEN", "Api_Key", ":", "=", " ", "'", "abcdef", "AKIA", "A1" * 9, "0a" * 12, "f" * 24, KEY40, "ABCDEFGHIJKL5678", "http://", "https://x",
        "db.internal", ".local", "s3.amazonaws.com", "é", "\n",
    ]
    seen = set()
    for _ in range(3000):
        text = "".join(pick.choices(parts, k=pick.randrange(1, 9))).encode()
        strong = [(0, *m.span()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
        strong += [(1, *m.span()) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 20]
        strong += [(2, *m.span()) for m in secrets.HEX.finditer(text)]
        weak = [(kind, *m.span()) for kind, pattern in ((3, secrets.WEAK_KEY), (4, secrets.WEAK_ID)) for m in pattern.finditer(text)]
        place = 0
        for m in secrets.ADDRESS.finditer(text):
            weak += [*((5, *h) for h in secrets._hosts(text, place, m.start())), (5, *m.span())]
            place = m.end()
        weak += [(5, *h) for h in secrets._hosts(text, place, len(text))]
        assert (_strong(text), _weak(text)) == (strong, weak)
        seen |= {kind for kind, _, _ in strong + weak}
    assert seen == set(range(6))


def test_hosts_are_what_one_pattern_says():
    """Against the plain pattern, which goes back over long runs; random strings of the parts that matter."""
    plain = re.compile(rb"\bhttps?://[^\s\"'<>]+|\b(?:[a-z0-9-]+\.)+(?:internal|amazonaws\.com|local)\b")
    pieces = [b"a", b"-", b".", b"..", b"X", b"_", b" ", b"internal", b"local", b"amazonaws.com", b".local", b"x.internal", b"https://", b"http", b"\xc3\xa9", b'"']
    rng = random.Random(5)
    for _ in range(20000):
        text = b"".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        assert _endpoints(text) == [m.span() for m in plain.finditer(text)], text


@pytest.mark.parametrize("part", [b"a.", b"a-", b"a", b"local.", b"a..", b"X.a", b"http", b"internal-"])
def test_long_runs_of_names_take_linear_time(part):
    text = part * 300_000
    begun = time.process_time()
    _weak(text)
    assert time.process_time() - begun < 10


def test_parts_are_linked_by_what_lies_between_them(spark):
    """A value of 700 characters right before an endpoint, and one with 301 characters between them."""
    value = "token=" + "x" * 700
    docs = spark.createDataFrame(
        [(1, f"{value} https://a.b"), (2, f"https://a.b {value}"), (3, f"{value}{' ' * 300}https://a.b"), (4, f"{value}{' ' * 301}https://a.b"),
         (5, f"https://a.b/{'y' * 2000} token=abcdef"), (6, f"https://h/{'y' * 900}/AKIA{'B2' * 8}/{'y' * 900}?secret=abcdefg")],
        "doc_id long, text string",
    )
    names = {k: [KINDS[s[0]] for s in v[1]] for k, v in spans(docs).items()}
    assert names == {
        1: ["assign", "endpoint"], 2: ["endpoint", "assign"], 3: ["assign", "endpoint"], 4: ["assign"], 5: ["endpoint", "assign"],
        6: ["endpoint", "access", "assign"],
    }


def test_awkward(awkward, no_documents):
    assert len(find_secrets(awkward).collect()) == len(awkward_texts())
    assert find_secrets(no_documents).collect() == []
    assert len(replace_personal_data(awkward, b"k").collect()) == len(awkward_texts())
    assert replace_personal_data(no_documents, b"k").collect() == []


def test_licences(spark, awkward, no_documents):
    known = known_licences(spark)
    docs = spark.createDataFrame(
        [(1, "Copyright (c) 2020 Someone\n\n" + KNOWN["MIT"].upper().replace(",", " ;")), (2, "text\nLicensed under CC BY-NC 4.0.\nmore"),
         (3, "before\n\n" + KNOWN["ISC"].replace("MERCHANTABILITY", "MERCHANTIBILITY") + "\n\nafter"), (4, "Not licensed under the Apache."),
         (5, None), (6, ""), (7, "Released under the MIT Licence."), (8, KNOWN["MIT"] + " and more")],
        "doc_id long, text string",
    )
    got = {r.doc_id: (r.whole, r.licences) for r in find_licences(docs, known).collect()}
    assert got == {
        1: (["MIT"], ["MIT"]), 2: ([], ["CC-BY-NC-4.0"]), 3: ([], ["ISC"]), 4: ([], []), 5: ([], []), 6: ([], []),
        7: (["MIT"], ["MIT"]), 8: ([], []),
    }
    assert {r.licence for r in known.collect()} == set(KNOWN) | set(DECLARED.values())
    assert len(find_licences(awkward, known).collect()) == len(awkward_texts())
    assert find_licences(no_documents, known).collect() == []
    assert {len(r.licences) for r in find_licences(docs, known.filter("false")).collect()} == {0}
    assert {len(r.licences) for r in find_licences(docs, spark.createDataFrame([(None, "x"), ("y", None), ("z", " ")], known.schema)).collect()} == {0}


def wrapped(text, width):
    lines, line = [], ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return "\n".join([*lines, line])


@pytest.mark.parametrize("width", [30, 61, 80])
def test_licence_files_as_they_come(spark, width):
    """Titles, paragraphs, any width of line (some begin with "copyright notice"), comment marks, README files."""
    cut = KNOWN["MIT"].index("The above"), KNOWN["MIT"].index("THE SOFTWARE IS")
    parts = [KNOWN["MIT"][: cut[0]], KNOWN["MIT"][cut[0] : cut[1]], KNOWN["MIT"][cut[1] :]]
    body = "\n\n".join(wrapped(p, width) for p in parts)
    file = f"MIT License\n\nCopyright (c) 2021 Some Body\n\n{body}\n"
    bsd = "\n\n".join("\n".join(wrapped(p, width).split("\n")) for p in re.split(r"\n(?=\d\.|THIS)", KNOWN["BSD-3-Clause"]))
    texts = [
        file, f"# Tool\n\nUse it.\n\n## License\n\n{body}\n\nThanks.", "\n".join(f" * {x}" for x in file.split("\n")),
        f"BSD 3-Clause License\n\nCopyright 2019, Some Body\nAll rights reserved.\n\n{bsd}", file.replace("sublicense", "sublet"),
        f"{body}\n\n{bsd}", f"x\n{wrapped(KNOWN['Unlicense'], width)}", body.replace("NONINFRINGEMENT", "NON-INFRINGEMENT"),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.whole, r.licences) for r in find_licences(docs, known_licences(spark)).collect()}
    mit, both = ["MIT"], ["BSD-3-Clause", "MIT"]
    assert got == {
        0: (mit, mit), 1: ([], mit), 2: (mit, mit), 3: (both[:1], both[:1]), 4: ([], []), 5: ([], both), 6: ([], ["Unlicense"]), 7: (mit, mit),
    }


def test_licences_against_all_runs_of_lines(spark):
    """Every run of whole lines, put in canonical form and looked up."""
    pick = random.Random(12)
    known = {"one": "a b c", "two": "b c", "three": "c 1.5 a b c a", "four": "Copyright notice b", "five": "b\nc"}
    pieces = ["a", "B", "c", "c 1.5", "a b", "", "Copyright 2020 a", "copyright", "notice b", "2. b", "(c) a", "c.", "all rights reserved.", "b c"]
    texts = ["\n".join(pick.choices(pieces, k=pick.randint(0, 12))) for _ in range(300)]
    forms: dict = {}
    for name, text in known.items():
        forms.setdefault(canonical(text), set()).add(name)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(known.items()), "licence string, text string")
    got = {r.doc_id: (set(r.whole), set(r.licences)) for r in find_licences(docs, table).collect()}
    found = 0
    for i, text in enumerate(texts):
        lines = text.split("\n")
        runs = {canonical("\n".join(lines[a:b])) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1)}
        want = set().union(*(forms.get(r, set()) for r in runs))
        found += len(want)
        assert got[i] == (forms.get(canonical(text), set()), want)
    assert found > 100


def test_licence_runs_in_long_texts():
    began = time.process_time()
    for text in ("a " * 1_000_000, "a\n" * 300_000, "*" * 1_000_000, " " * 1_000_000, "copyright " * 100_000, "\n" * 1_000_000):
        runs_of_lines(text, {i: [1, 2, 150] for i in range(4096)})
    assert time.process_time() - began < 30


@pytest.mark.parametrize("size", [1, 2, 7, 1000, 36525])
def test_permutation(size):
    f = Feistel(b"key")
    image = [f.permute("t", size, x) for x in range(size)]
    assert sorted(image) == list(range(size))
    assert all(f.permute("t", size, y, back=True) == x for x, y in list(enumerate(image))[:200])


def test_pseudonyms_keep_format_and_links():
    f = Feistel(b"key")
    text = (
        "Mail jo.doe7@mail.example.com, card 4111 1111 1111 1111 or 4111-1111-1111-1111, DE89 3704 0044 0532 0130 00, from 10.0.0.255, "
        "born 1999-02-28, 28.2.1999, 30/12/2001, 02/28/1999, no 123-45-6789, call +1 (212) 555-0199 or +44 20 7946 0958."
    )
    new, found = pseudonymise(text, f)
    assert [k for k, _, _ in found] == ["email", "card", "card", "iban", "ip", "date", "date", "date", "date", "ssn", "phone", "phone"]
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[0-9]", "0", re.sub(r"(\d+\.){3}\d+", "ip", t)))
    assert shape(new) == shape(text) and pseudonymise(new, f, back=True)[0] == text
    cards = [re.sub("[ -]", "", c) for c in re.findall(r"(?:\d{4}[ -]){3}\d{4}", new)]
    assert cards[0] == cards[1] != "4" + "1" * 15 and luhn(cards[0][:-1]) == int(cards[0][-1])
    assert pseudonymise(text, Feistel(b"another"))[0] != new


def test_only_texts_with_a_digit_or_an_address_are_matched(monkeypatch):
    texts = ["plain é words", None, "", "mail ann.b@example.org now", "on 2024-02-29 at 10.0.0.1", "card 4111 1111 1111 1111", "a @ b", "x" * 50]
    ids = list(range(len(texts)))
    batch = pa.RecordBatch.from_pydict({"id": pa.array(ids), "text": pa.array(texts)})
    f = Feistel(b"k")
    want = [(i, *((None, []) if t is None else pseudonymise(t, f))) for i, t in zip(ids, texts)]
    assert sum(bool(found) for _, _, found in want) == 3
    seen = []
    plain = pseudonyms.pseudonymise
    monkeypatch.setattr(pseudonyms, "pseudonymise", lambda text, *more: seen.append(text) or plain(text, *more))
    # A part of a batch, too.
    for first in (0, 2):
        got = [r for b in pseudonyms._replaced(b"k", False)(iter([batch.slice(first)])) for r in b.to_pylist()]
        assert [(r["id"], r["text"], [tuple(s.values()) for s in r["spans"]]) for r in got] == want[first:]
    assert set(seen) == set(texts[3:7])


def test_what_fails_its_check_stays():
    for text in ("4111 1111 1111 1112", "999.1.1.1", "2025-13-40", "000-12-3456", "version 1.2.3", "12345678", "DE00 3704 0044 0532 0130 00"):
        assert pseudonymise(text, Feistel(b"k"))[0] == text
