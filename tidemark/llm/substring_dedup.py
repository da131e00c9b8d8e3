"""Remove passages that occur earlier in the corpus: seed with winnowed anchors, extend, merge.

1. Every window of ``length`` words has one anchor, its smallest k-gram of words (winnowing), so
   equal windows meet at equal anchors. An anchor's *span* is the union of the windows it stands for.
   Each task first settles its own repeats of a span, so a hot passage sends one row a slice.
2. Anchors are grouped by hash. A span seen earlier is removed whole. An anchor whose spans differ
   (the edges of a shared passage) is extended both ways, window by window.
3. Extended windows are joined by a 128-bit hash of their words. All but the first occurrence go.
   Adjacent windows merge into maximal repeats when a document's words are kept or removed.

No pairs are made: each occurrence is compared with the first one only, which settles the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keyed
from tidemark.llm.words import BETWEEN_SPACES, U64, Grams, find_words, mix, signed, slices, starts_of_runs, winnow

SPAN, EXTEND, REPEAT = 0, 1, 2
_FOUND = "kind int, a long, b long, several boolean, doc long, th long, start long, n long"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _rows(kind, a, b, several, doc, th, start, n) -> pa.RecordBatch:
    size = len(doc)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.broadcast_to(np.asarray(kind, np.int32), size)),
            pa.array(signed(a)), pa.array(signed(b)),
            pa.array(np.broadcast_to(np.asarray(several, bool), size)),
            pa.array(doc), pa.array(th), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int64)),
        ],
        _NAMES,
    )


def _settle(a, b, doc, start):
    """Order rows by (a, b, doc, start); tell which begin a group of a, of (a, b), and which repeat
    an earlier place of their (a, b)."""
    order = np.lexsort((start, doc, b, a))
    a, b, doc, start = a[order], b[order], doc[order], start[order]
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_b = new_a.copy()
    new_b[1:] |= b[1:] != b[:-1]
    first = np.maximum.accumulate(np.where(new_b, np.arange(len(a)), 0))
    repeat = (doc != doc[first]) | (start != start[first])
    return order, new_a, new_b, repeat


def _repeats(doc, th, start, n) -> pa.RecordBatch:
    """Repeated windows as decided rows, runs of adjacent ones merged."""
    order = np.lexsort((start, th, doc))
    doc, th, start, n = doc[order], th[order], start[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (start[1:] > start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    ends = np.maximum.reduceat(start + n, at)
    doc, th, start = doc[at], th[at], start[at]
    where = mix(mix(doc.view(U64)) ^ start.view(U64))
    return _rows(REPEAT, where, where, False, doc, th, start, ends - start)


def _anchors(length: int, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            words = find_words(data, offsets, BETWEEN_SPACES)
            grams = Grams(words)
            at, first, last = winnow(words, grams, length, k)
            if not len(at):
                continue
            row = np.searchsorted(words.bounds, at, side="right") - 1
            doc = batch.column("doc").to_numpy()[row]
            th = batch.column("th").to_numpy()[row]
            start, n = first - words.bounds[row], last - first + 1
            a = grams.of(at, at + k)
            b = mix(grams.of(first, last + length) + mix((at - first).astype(U64) << U64(20) | n.astype(U64)))
            order, new_a, new_b, repeat = _settle(a, b, doc, start)
            a, b, doc, th, start, n = (x[order] for x in (a, b, doc, th, start, n))
            if repeat.any():
                yield _repeats(doc[repeat], th[repeat], start[repeat], n[repeat])
            group = np.cumsum(new_a) - 1
            several = (np.bincount(group, weights=new_b) > 1)[group]
            # Where this slice knows that an anchor has several spans, one row tells the others so.
            kind = np.where(several & ~new_a, EXTEND, SPAN)
            key = np.where(kind == EXTEND, mix(doc.view(U64) ^ mix(start.view(U64))), a)
            keep = ~repeat
            yield _rows(kind[keep], key[keep], b[keep], several[keep], doc[keep], th[keep], start[keep], n[keep])

    return find


def _windows(length: int):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (b.filter(b.column("found").is_valid()) for b in batches)
        for batch, data, offsets in slices((b for b in held if b.num_rows), "text"):
            found = batch.column("found")
            flat = found.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            kind, start, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            doc, th = batch.column("doc").to_numpy()[row], batch.column("th").to_numpy()[row]
            done = kind == REPEAT
            if done.any():
                yield _repeats(doc[done], th[done], start[done], n[done])
            if done.all():
                continue
            words = find_words(data, offsets, BETWEEN_SPACES)
            row, start, n = row[~done], start[~done], n[~done]
            each = np.repeat(np.arange(len(row)), n)
            begin = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            row = row[each]
            at = words.bounds[row] + begin
            a, b = (Grams(words, which).of(at, at + length) for which in (0, 1))
            doc, th = batch.column("doc").to_numpy()[row], batch.column("th").to_numpy()[row]
            order, _, _, repeat = _settle(a, b, doc, begin)
            a, b, doc, th, begin = (x[order] for x in (a, b, doc, th, begin))
            if repeat.any():
                yield _repeats(doc[repeat], th[repeat], begin[repeat], np.ones(int(repeat.sum()), np.int64))
            keep = ~repeat
            yield _rows(SPAN, a[keep], b[keep], False, doc[keep], th[keep], begin[keep], np.ones(int(keep.sum()), np.int64))

    return extend


def _keep(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            words = find_words(data, offsets, BETWEEN_SPACES)
            found = batch.column("found")
            flat = found.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            start, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            at = words.bounds[row] + start
            change = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + n + length - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed = np.concatenate(([0], np.cumsum(gone)))
            removed = removed[words.bounds[1:]] - removed[words.bounds[:-1]]
            held = data.tobytes()
            texts = []
            for i in range(batch.num_rows):
                lot = held[offsets[i]:offsets[i + 1]].split()
                if removed[i]:
                    stay = ~gone[words.bounds[i]:words.bounds[i + 1]]
                    lot = [lot[j] for j in np.flatnonzero(stay)]
                texts.append(b" ".join(lot))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)),
                 pa.array(texts, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "kept_text"],
            )

    return cut


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, k: int = 8) -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``n_removed`` and ``kept_text``.

    A word goes if some window of ``length`` words that covers it also starts earlier: in a document
    of smaller id, or earlier in the same one. Windows are judged on the input. Words are what stands
    between ASCII white space; kept words are joined by one space. Null text has no words. Rows that
    repeat an id with an equal text are one document and keep the same words; a null id is the
    smallest. Other columns are ignored. An empty table gives an empty result.
    """
    source = keyed(docs, id_col, text_col)
    place = F.struct("doc", "start")
    key = Window.partitionBy("a", "kind")
    spans = source.select("doc", "th", "text").mapInArrow(_anchors(length, k), _FOUND)
    compared = (
        spans.withColumn("first", F.min(place).over(Window.partitionBy("a", "kind", "b")))
        .withColumn("more", F.max("several").over(key) | (F.min("b").over(key) != F.max("b").over(key)))
        .withColumn(
            "kind",
            F.when(F.col("kind") != SPAN, F.col("kind")).when(place > F.col("first"), REPEAT).when(F.col("more"), EXTEND),
        )
        .filter(F.col("kind").isNotNull())
    )
    seeds = compared.groupBy("doc", "th").agg(F.collect_list(F.struct("kind", "start", "n")).alias("found"))
    windows = source.join(seeds, ["doc", "th"], "left").mapInArrow(_windows(length), _FOUND)
    later = (
        windows.withColumn("first", F.min(place).over(Window.partitionBy("a", "b", "kind")))
        .filter((F.col("kind") == REPEAT) | (place > F.col("first")))
        .groupBy("doc", "th")
        .agg(F.collect_list(F.struct("start", "n")).alias("found"))
    )
    none = F.array().cast("array<struct<start:bigint,n:bigint>>")
    id_type = docs.schema[id_col].dataType.simpleString()
    return (
        source.join(later, ["doc", "th"], "left")
        .withColumn("found", F.coalesce("found", none))
        .mapInArrow(_keep(length), f"id {id_type}, n_words long, n_removed long, kept_text string")
        .withColumnRenamed("id", id_col)
    )
