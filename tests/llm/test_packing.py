"""Token ids and packing by exact round trips."""

import random

import pytest
from tokenizers import Tokenizer

import public_tokenizers
from tests.llm.conftest import awkward_texts
from tidemark.llm.packing import RoomTree, pack_documents, pack_lengths

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_first_fit_by_tree_equals_a_scan():
    pick = random.Random(1)
    tree, room = RoomTree(50, 100), [100] * 50
    for _ in range(100):
        need = pick.randrange(1, 50)
        first = next(i for i, r in enumerate(room) if r >= need)
        room[first] -= need
        assert tree.first_fit(need) == first


@pytest.mark.parametrize("lengths", [[], [1], [2048], [1500] * 9, list(range(1, 400)), [2047, 1, 2047, 2]])
def test_pieces_cover_items_and_fill_sequences(lengths):
    pieces = pack_lengths(lengths, 2048)
    for item, n in enumerate(lengths):
        mine = sorted(p[1:3] for p in pieces if p[0] == item)
        assert sum(size for _, size in mine) == n
        assert all(a + size == b for (a, size), (b, _) in zip(mine, mine[1:]))
    bins = {p[3] for p in pieces}
    assert len(bins) == -(-sum(lengths) // 2048) or sum(lengths) > 2048 * (len(bins) - 1)
    for b in bins:
        at = 0
        for _, _, size, _, offset in sorted((p for p in pieces if p[3] == b), key=lambda p: p[4]):
            assert offset == at
            at += size
        assert at <= 2048


def test_round_trip(awkward, no_documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pack_documents(awkward, PATH, PATTERN, capacity=64, group_documents=4).collect()
    want = sorted((i if i is not None else -1, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in awkward_texts())
    pieces = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        pieces.setdefault((r.doc_id if r.doc_id is not None else -1, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    got = []
    for (key, total), lot in pieces.items():
        copies = len(lot) * 0 + sum(len(x) for _, x in lot) // 4 // total
        starts = sorted(lot)
        joined = b"".join(x for _, x in starts[::copies] if copies == 1) if copies == 1 else None
        if copies == 1:
            got.append((key, tuple(int.from_bytes(joined[i:i + 4], "little") for i in range(0, len(joined), 4))))
    assert sorted(got) == [w for w in want if w[0] != 20]
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for lot in filled.values():
        at = 0
        for offset, length in sorted(lot):
            assert offset == at
            at += length
        assert at <= 64
    assert pack_documents(no_documents, PATH, PATTERN).collect() == []


def test_odd_blanks_and_marks(spark):
    texts = ["", " ", "a  b", "a\n", "\na b\n\nc", " é x", "<|endoftext|> a", "a.b", "a.'s it's", "漢 字 b", "x\ty z", "a b c", "x,5.5 ,", "a \nb"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.ids) for r in pack_documents(docs, PATH, PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        assert got[i] == b"".join(x.to_bytes(4, "little") for x in ids)


def test_added_tokens_get_their_ids():
    """The ``tokenizers`` form at its default reads the literal of an added token as that token."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import Encoder

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"x\n{end}\ny, {end}. z", f"two  {end}  blanks", f"word{end}word <|endoftext |>", "<|endof", "none at all."]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    ids, bounds = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode(data, offsets)
    got = [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:])]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
