"""Pack documents into training sequences: first-fit decreasing within randomised groups.

Documents are dealt to groups by a hash of their id, so that no source or order decides who shares a
group, and a group has about ``group_documents`` documents at any size of input. Whole sequences'
worth of a document's tokens fill sequences of their own; what is left is placed, longest first, into
the first sequence with room. A tournament tree of the room left finds that sequence in a step per
level. At last, sequences that stay short are cut up to fill the gaps of others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keyed
from tidemark.llm.tokens import Encoder
from tidemark.llm.words import slices

END_OF_TEXT = 1


class RoomTree:
    """A tournament tree over bins; every node holds the largest room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [room] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """Take ``need`` from the first bin that has it."""
        node = 1
        while node < self.leaves:
            node *= 2
            if self.room[node] < need:
                node += 1
        self.room[node] -= need
        bin_ = node - self.leaves
        node //= 2
        while node:
            self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])
            node //= 2
        return bin_


def pack_lengths(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """First-fit decreasing. Each item becomes one or more pieces ``(item, from, length, bin, offset)``.

    Items are placed whole, in order of falling length (ties in the order given). Then the emptiest
    bins are dissolved while others have room: their items are cut to fill the gaps.
    """
    if not lengths:
        return []
    tree = RoomTree(len(lengths), capacity)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        bins.setdefault(tree.first_fit(lengths[item]), []).append((item, 0, lengths[item]))
    fill = {b: sum(p[2] for p in pieces) for b, pieces in bins.items()}
    order = sorted(fill, key=lambda b: (fill[b], b))
    gaps = sum(capacity - f for f in fill.values())
    loose: list[tuple[int, int, int]] = []
    while order and gaps >= capacity:
        emptiest = order.pop(0)
        loose += bins.pop(emptiest)
        gaps -= capacity
    for bin_ in reversed(order):
        room = capacity - fill[bin_]
        while room and loose:
            item, start, size = loose.pop()
            take = min(room, size)
            bins[bin_].append((item, start, take))
            room -= take
            if take < size:
                loose.append((item, start + take, size - take))
    placed = []
    for number, bin_ in enumerate(sorted(bins)):
        at = 0
        for item, start, size in bins[bin_]:
            placed.append((item, start, size, number, at))
            at += size
    return placed


def _tokenised(path: str, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch, data, offsets in slices(batches, "text"):
            ids, bounds = encoder.encode(data, offsets)
            lots = [np.append(ids[s:e], np.uint32(END_OF_TEXT)).astype("<u4").tobytes() for s, e in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc"), batch.column("th"), batch.column("id"), pa.array(lots, pa.binary())],
                ["part", "doc", "th", "id", "ids"],
            )

    return encode


_PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _packed(capacity: int):
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc", "ascending"), ("th", "ascending")])
        part = group.column("part")[0].as_py() if group.num_rows else 0
        lots = group.column("ids").to_pylist()
        tokens = [len(x) // 4 for x in lots]
        rows: list[tuple[int, int, int, int, int]] = []
        number = 0
        rest = [n % capacity for n in tokens]
        for doc, n in enumerate(tokens):
            for start in range(0, n - n % capacity, capacity):
                rows.append((doc, start, capacity, number, 0))
                number += 1
        some = [d for d, n in enumerate(rest) if n]
        for item, start, size, bin_, at in pack_lengths([rest[d] for d in some], capacity):
            doc = some[item]
            rows.append((doc, tokens[doc] - rest[doc] + start, size, number + bin_, at))
        doc, start, size, bin_, at = (np.array(x, np.int64) for x in zip(*rows))
        return pa.table({
            "id": group.column("id").take(pa.array(doc)),
            "start": start, "length": size,
            "ids": pa.array([lots[d][4 * s:4 * (s + n)] for d, s, n in zip(doc, start, size)], pa.binary()),
            "doc_tokens": np.array(tokens, np.int64)[doc],
            "sequence_id": (np.int64(part) << np.int64(32)) + bin_, "offset": at,
        })

    return pack


def pack_documents(
    docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = 2048, group_documents: int = 2000,
) -> DataFrame:
    """One row per piece: the document's id, ``start`` and ``length`` of the piece in its tokens,
    ``ids`` (little-endian 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence.

    A document's tokens are its text's ids and then id 1; null text is empty, so every row gives at
    least one token. Each token lies in exactly one piece and sequences have no gaps. Equal rows are
    packed each. Other columns are ignored. An empty table gives an empty result.
    """
    groups = max(1, round(docs.count() / group_documents))
    id_type = docs.schema[id_col].dataType.simpleString()
    return (
        keyed(docs, id_col, text_col)
        .withColumn("part", F.pmod(F.xxhash64("doc", "th", F.lit(7)), F.lit(groups)))
        .mapInArrow(_tokenised(tokenizer_path, pattern), f"part long, doc long, th long, id {id_type}, ids binary")
        .groupBy("part")
        .applyInArrow(_packed(capacity), f"id {id_type}, {_PIECES}")
        .withColumnRenamed("id", id_col)
    )
