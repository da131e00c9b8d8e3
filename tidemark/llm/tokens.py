"""Token ids of whole texts by a public byte-level BPE vocabulary, each distinct stretch encoded once.

The vocabulary's splitting rule never joins what stands on both sides of a single space or line end
between ordinary characters, or of a full stop or comma after a letter. Texts are cut there, equal
stretches are found by hash (two hashes of 64 bits must agree), and only stretches not seen before are
encoded. The ranks of the merges come from the vocabulary file in its ``tiktoken`` form, which encodes
single stretches several times faster than the ``tokenizers`` form and to the same ids. Added tokens, such as the
end of a text, are read from the ``json`` form beside it; their literals have no place to cut and get their ids.
"""

from __future__ import annotations

import base64
import json
from array import array
from functools import partial
from pathlib import Path

import numpy as np

from tidemark.llm.words import BYTE_HASHES

CACHED = 150_000


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a stretch begins."""
    n = len(data)
    plain = (data > 0x20) & (data < 0x7F)
    # Two-byte characters but those that begin with 0xC2, which has blanks too.
    lead = (data >= 0xC3) & (data <= 0xDF)
    second = np.zeros(n, bool)
    second[1:] = lead[:-1]
    left = np.zeros(n, bool)
    left[1:] = (plain | second)[:-1]
    right = np.zeros(n, bool)
    right[:-1] = (plain | lead)[1:]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    # A blank at either end of a document is not between characters of it.
    inner = left & right & ~edge[:n] & ~edge[1:]
    lone = np.flatnonzero(inner & ((data == 0x20) | (data == 0x0A)))
    letter = np.zeros(n, bool)
    letter[1:] = (((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80))[:-1]
    begin = edge
    begin[:n] |= letter & ((data == 0x2C) | (data == 0x2E))
    begin[lone] = True
    begin[lone[data[lone] == 0x0A] + 1] = True
    return np.flatnonzero(begin[:n])


def _added(path: str) -> dict[str, int]:
    """The added tokens of the vocabulary's ``json`` form, if it lies beside the ranks."""
    form = Path(path).with_suffix(".json")
    if not form.exists():
        return {}
    return {t["content"]: t["id"] for t in json.loads(form.read_text(encoding="utf-8")).get("added_tokens", [])}


class Encoder:
    """Encodes slices of documents; keeps the ids of stretches it has seen, up to a bound."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=_added(path))
        self.encode_one = partial(encoding.encode, allowed_special="all")
        self.seen: dict[bytes, bytes] = {}

    def _encode(self, stretches: list[bytes]) -> list[bytes]:
        if len(self.seen) > CACHED:
            self.seen.clear()
        seen, one = self.seen, self.encode_one
        out = []
        for stretch in stretches:
            ids = seen.get(stretch)
            if ids is None:
                ids = seen[stretch] = array("I", one(stretch.decode())).tobytes()
            out.append(ids)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents in a row, and where each document's ids begin."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = _cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = [kind.ranges(kind.sums(kind.values[data]), starts, ends) for kind in BYTE_HASHES]
        _, first, of = np.unique(hashes[0], return_index=True, return_inverse=True)
        if (hashes[1] != hashes[1][first][of]).any():
            first = of = np.arange(len(starts))
        held = data.tobytes()
        ids = self._encode([held[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        base = np.cumsum(size) - size
        n = size[of]
        total = np.cumsum(n)
        gather = np.arange(total[-1]) + np.repeat(base[of] - (total - n), n)
        return flat[gather], np.concatenate(([0], total))[np.searchsorted(starts, offsets)]
