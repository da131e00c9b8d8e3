"""Find passages of a benchmark in documents by winnowing.

Each window of ``length`` item words, and each shorter item as a whole, has one fingerprint: the
smallest hash of its k-grams. Documents are winnowed alike, so a shared window always shares a
fingerprint. Fingerprints that meet are extended to the windows around them, and those are joined
by a 128-bit hash with the windows of the items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, sent_if_small, staged
from tidemark.llm.words import ALPHANUMERIC, LOWER, U64, Grams, find_words, mix, signed, slices, winnow


def _grain(length: int) -> int:
    return (length + 1) // 2


def _salted(hashes: np.ndarray, length: int) -> np.ndarray:
    return signed(mix(hashes + U64(length)))


def _item_windows(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            words = find_words(LOWER[data], offsets, ALPHANUMERIC)
            grams, again = Grams(words), Grams(words, 1)
            own = np.minimum(words.counts, length)
            for size in np.unique(own[own > 0]).tolist():
                at, first, last = winnow(words, grams, size, _grain(size))
                each = np.repeat(np.arange(len(at)), last - first + 1)
                begin = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
                row = np.searchsorted(words.bounds, begin, side="right") - 1
                mine = own[row] == size
                begin, each, row = begin[mine], each[mine], row[mine]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row)), pa.array(np.full(len(row), size, np.int64)),
                     pa.array(_salted(grams.of(at, at + _grain(size)), size)[each]),
                     pa.array(_salted(grams.of(begin, begin + size), size)), pa.array(signed(again.of(begin, begin + size)))],
                    ["item", "size", "mark", "a", "b"],
                )

    return find


def _fingerprints(sizes: list[int]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            words = find_words(LOWER[data], offsets, ALPHANUMERIC)
            grams = Grams(words)
            for size in sizes:
                at, first, last = winnow(words, grams, size, _grain(size))
                row = np.searchsorted(words.bounds, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_salted(grams.of(at, at + _grain(size)), size)), batch.column("doc").take(pa.array(row)),
                     batch.column("th").take(pa.array(row)), pa.array(np.full(len(row), size, np.int64)),
                     pa.array(first - words.bounds[row]), pa.array(last - first + 1)],
                    ["mark", "doc", "th", "size", "start", "n"],
                )

    return find


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = (b.filter(b.column("found").is_valid()) for b in batches)
    for batch, data, offsets in slices((b for b in held if b.num_rows), "text"):
        words = find_words(LOWER[data], offsets, ALPHANUMERIC)
        grams, again = Grams(words), Grams(words, 1)
        found = batch.column("found")
        row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
        size, start, n = (found.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
        each = np.repeat(np.arange(len(row)), n)
        start = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        row, size = row[each], size[each]
        at = words.bounds[row] + start
        a = signed(mix(grams.of(at, at + size) + size.astype(U64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(signed(again.of(at, at + size))), batch.column("doc").take(pa.array(row)),
             batch.column("th").take(pa.array(row)), pa.array(size), pa.array(start)],
            ["a", "b", "doc", "th", "size", "start"],
        )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches, "text"):
        words = find_words(LOWER[data], offsets, ALPHANUMERIC)
        hits = batch.column("hits")
        row = np.repeat(np.arange(batch.num_rows), np.diff(hits.offsets.to_numpy()))
        size, start = (hits.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
        change = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(change, words.bounds[row] + start, 1)
        np.add.at(change, words.bounds[row] + start + size, -1)
        hit = np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) > 0)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("th"), batch.column("id"), pa.array(words.counts.astype(np.int64)),
             pa.array((hit[words.bounds[1:]] - hit[words.bounds[:-1]]).astype(np.int64)), batch.column("items")],
            ["doc", "th", "id", "n_words", "n_hit", "items"],
        )


def find_benchmark_passages(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", length: int = 10,
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``n_hit`` (words inside any occurrence of a window)
    and ``items`` (the distinct ids of items with occurring windows), and the keys ``doc, th``.

    Words are runs of digits, letters (A-Z in lower case) and characters beyond ASCII. A window is
    ``length`` consecutive words of an item, or all words of a shorter item. Null or empty text has
    no words, an item without words no window. Items may repeat. An empty table on either side gives
    no hits. Other columns are ignored. ``length`` is bounded by the number of sizes kept apart.
    """
    id_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((docs, id_col), (items, item_id_col)))
    known = staged(
        items.select(F.col(f"`{item_id_col}`").alias("id"), F.col(f"`{item_text_col}`").alias("text"))
        .mapInArrow(_item_windows(length), f"item {item_type}, size long, mark long, a long, b long")
        .distinct()
    )
    sizes = sorted(r.size for r in known.select("size").distinct().collect())  # at most ``length`` numbers
    rows = known.count()
    marks = sent_if_small(known.select("mark").distinct(), 64, rows)
    source = keyed(docs, id_col, text_col)
    seeds = (
        source.select("doc", "th", "text")
        .mapInArrow(_fingerprints(sizes), "mark long, doc long, th long, size long, start long, n long")
        .join(marks, "mark", "left_semi")
        .groupBy("doc", "th")
        .agg(F.collect_list(F.struct("size", "start", "n")).alias("found"))
    )
    hits = (
        source.join(seeds, ["doc", "th"], "left")
        .mapInArrow(_extended, "a long, b long, doc long, th long, size long, start long")
        .join(sent_if_small(known.select("a", "b", "item"), 80, rows), ["a", "b"])
        .groupBy("doc", "th")
        .agg(F.collect_set(F.struct("size", "start")).alias("hits"), F.collect_set("item").alias("items"))
    )
    return (
        source.join(hits, ["doc", "th"], "left")
        .withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<size:bigint,start:bigint>>")))
        .withColumn("items", F.coalesce("items", F.array().cast(f"array<{item_type}>")))
        .mapInArrow(_counted, f"doc long, th long, id {id_type}, n_words long, n_hit long, items array<{item_type}>")
        .withColumnRenamed("id", id_col)
    )
