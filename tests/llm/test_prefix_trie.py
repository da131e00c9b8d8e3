"""The trie of conversations against one built by hand."""

import random
import zlib
from hashlib import sha256

import pytest

from tidemark.llm import prefix_trie as module
from tidemark.llm.prefix_trie import continued, hashed_member_lists, prefix_trie, turn_digests

SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth string, p1 string, n string, base string"


def rebuilt_by_hand(rows, group=100, heads=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = own.get(c - c % group, [])[:h] + turns[h:]
    return out


def trie_by_hand(rebuilt):
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[:len(path)] == path]
        childless = [p for p in below if not any(q[:-1] == p for q in members if q)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(who) if len(rebuilt[c]) == len(path))
        out.append((
            min(who), len(path), min(members[path[:-1]]) if path else None, len(who),
            sum(1 for q in members if q and q[:-1] == path), len(childless), saved, sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None, "z", "b") for r in rows], SCHEMA).repartition(5)


def trie(spark, rows, **options):
    return sorted((tuple(r) for r in prefix_trie(*continued(turn_digests(table(spark, rows))), **options).collect()), key=str)


def alike(seed, n, most=9):
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(pick.randrange(1, most)):
            rows.append((c, t, pick.choice(["user", "assistant", None]), pick.choice(["", "hello", "é漢" * pick.randrange(3), None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_beginnings(spark, seed):
    rows = alike(seed, 130)
    assert trie(spark, rows) == trie_by_hand(rebuilt_by_hand(rows))


def test_a_full_sketch_changes_nothing(spark):
    """With hardly any cells everything is suspected, with many next to nothing is: equal rows come out."""
    rows = [*alike(4, 60), *[(200 + c, t, "user", f"own {c} {t}") for c in range(30) for t in range(6)]]
    want = trie_by_hand(rebuilt_by_hand(rows))
    for cells in (8, 1 << 12):
        assert trie(spark, rows, max_cells=cells) == want


def test_singletons_are_proven(spark):
    """Tails that one conversation has alone are not shuffled."""
    rows = [(100 * c, t, "user", f"{c} {t}" if t else "the same") for c in range(40) for t in range(20)]
    turns, _ = continued(turn_digests(table(spark, rows)))
    path = turns.select("depth", F_hash("d1", "depth"), F_hash("d2", "depth"))
    bits = module._crowded_cells(path, module._BLOCK)
    crowded = sum(bin(b).count("1") for b in bits)
    assert 0 < crowded < 0.05 * 3 * 800


def F_hash(*columns):
    from pyspark.sql import functions as F

    return F.xxhash64(*columns).alias("p1" if columns[0] == "d1" else "p2")


def test_odd_conversations(spark):
    rows = [
        # Bases that are short or absent, and conversations that have no turns left.
        (0, 0, "user", "a"), *[(c, 0, "user", f"only {c}") for c in range(1, 40)], *[(c, 0, "user", "lost") for c in range(301, 330)],
        # Null turns first, ties, repeated rows, nulls.
        (400, None, "user", "first"), (400, 2, "user", "b"), (400, 2, "user", "b"), (400, 2, "user", "b"), (400, 1, None, None),
        (401, 1, "user", "x"), (401, 1, "assistant", "x"), (None, 0, "user", "nowhere"), (500, 0, "user", "long " * 40_000), (501, 0, "user", "z"),
    ]
    assert len({str(r) for r in trie(spark, rows)}) == len(trie(spark, rows))
    got, want = trie(spark, rows), trie_by_hand(rebuilt_by_hand(rows))
    # Equal turns may be ordered either way where only the digest decides.
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[3:] for r in got] == [r[3:] for r in want]


def test_long_copies(spark):
    """Copies of one long conversation, and one that goes on after it."""
    long = [("user", f"{t}") for t in range(300)]
    rows = [(1000 * c, t, *said) for c in range(7) for t, said in enumerate(long)] + [(9000, t, "user", f"{t}") for t in range(310)]
    rows = [r for r in rows if r[0] != 0]
    got = {r[:2]: r[2:] for r in trie(spark, rows)}
    assert len(got) == 311 and got[1000, 300][:4] == (1000, 7, 1, 1) and got[9000, 301][:4] == (1000, 1, 1, 1)
    assert got[1000, 0][1:5] == (7, 1, 1, sum(6 * len(str(t)) for t in range(300)))
    assert got[1000, 300][5] == sha256(",".join(str(1000 * c) for c in range(1, 7)).encode()).hexdigest()


def test_member_lists_over_ranges(spark):
    ids = list(range(-50, 5000))
    rows = [(1, 2, 3, i) for i in ids] + [(1, 2, 4, 7), (2, 0, 0, 9), (2, 0, 0, 8)]
    members = spark.createDataFrame(rows, "depth long, p1 long, p2 long, conv long").repartition(6)
    got = {r[:3]: r[3] for r in map(tuple, hashed_member_lists(members, piece_bytes=50).collect())}
    texts = {(1, 2, 3): ",".join(map(str, ids)), (1, 2, 4): "7", (2, 0, 0): "8,9"}
    assert got == {k: sha256(t.encode()).hexdigest() for k, t in texts.items()}


def test_no_conversations(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []
