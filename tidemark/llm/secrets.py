"""Find secrets in texts, and weak candidates where the parts of a credential stand together.

Strong patterns are reported wherever they match. Weak candidates (a bare key of 40 characters, an
identifier in capitals, an endpoint) mean little alone. They are joined by interval within a document:
a weak key is reported if no more than ``scope`` characters lie between it and an identifier, weak or strong, and a
weak identifier or an endpoint if that holds of a key. The join compares what lies in the same or the next stretch of
``scope`` characters, so no document, however long or full of candidates, meets itself as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, staged
from tidemark.llm.words import slices

# The strong patterns, the least length of what they find, and the order of kinds.
ASSIGN = re.compile(
    rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
# Runs below the least length are dropped, so asking for it at once finds the same.
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "weak_key", "weak_id", "endpoint")

# A bare key: 40 characters of base64, with both cases and a digit, on its own.
WEAK_KEY = re.compile(
    rb"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])(?=[0-9A-Z+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])"
)
# An identifier: four capitals and twelve or more capitals and digits, with a digit, on its own.
WEAK_ID = re.compile(rb"(?<![A-Za-z0-9])(?!AKIA)(?=[A-Z]*[0-9])[A-Z]{4}[A-Z0-9]{12,28}(?![A-Za-z0-9])")
ADDRESS = re.compile(rb"\bhttps?://[^\s\"'<>]+")
# A run of labels, matched once from its first character; what in it ends in a private domain is looked up after that,
# so a run costs no more than its length.
_LABELS = re.compile(rb"(?<![a-z0-9-])[a-z0-9-]++(?:\.[a-z0-9-]++)++")
_DOMAIN = re.compile(rb"(?<=\.)(?:internal|amazonaws\.com|local)\b")
_LABEL = re.compile(rb"\b[a-z0-9-]")

# What a text must hold for a pattern to match. Looking for that is much faster than matching, and few texts hold it.
_DIGIT = re.compile(rb"[0-9]")
_HEX_MARKS = bytes(ord("0") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))
_HEX_RUN = b"0" * 24
_DOMAINS = (b".internal", b".amazonaws.com", b".local")

_SPAN = "struct<kind:int,start:bigint,end:bigint>"


def _strong(text: bytes) -> list[tuple[int, int, int]]:
    found = []
    if b":" in text or b"=" in text:
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if _HEX_RUN in text.translate(_HEX_MARKS):
        found += [(2, *m.span()) for m in HEX.finditer(text)]
    return found


def _hosts(text: bytes, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Names of hosts in private domains: from a word's edge to the last such domain of a run of labels."""
    for run in _LABELS.finditer(text, begin, end):
        last = None
        for last in _DOMAIN.finditer(text, run.start(), min(run.end() + 1, end)):
            pass
        first = last and _LABEL.search(text, run.start(), last.start() - 1)
        if first:
            yield first.start(), last.end()


def _endpoints(text: bytes) -> list[tuple[int, int]]:
    """Addresses, and between them hosts."""
    addresses = [m.span() for m in ADDRESS.finditer(text)] if b"://" in text else []
    if not any(domain in text for domain in _DOMAINS):
        return addresses
    found, place = [], 0
    for start, end in addresses:
        found += [*_hosts(text, place, start), (start, end)]
        place = end
    return [*found, *_hosts(text, place, len(text))]


def _weak(text: bytes) -> list[tuple[int, int, int]]:
    found = []
    if _DIGIT.search(text):
        found = [(kind, *m.span()) for kind, pattern in ((3, WEAK_KEY), (4, WEAK_ID)) for m in pattern.finditer(text)]
    return found + [(5, *span) for span in _endpoints(text)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch, data, offsets in slices(batches, "text"):
        held = data.tobytes()
        inside = (data & 0xC0) == 0x80
        strong, weak = [], []
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text = held[s:e]
            both = [_strong(text), _weak(text)]
            if any(both):
                # Code points before each byte.
                before = np.concatenate(([0], np.cumsum(~inside[s:e])))
                both = [[(k, int(before[a]), int(before[b])) for k, a, b in found] for found in both]
            for found, out in zip(both, (strong, weak)):
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(found, key=lambda f: (f[1], f[0]))])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("th"), batch.column("id"), pa.array(strong, kind), pa.array(weak, kind)],
            ["doc", "th", "id", "strong", "weak"],
        )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """Per row of ``docs``: its id, ``strong`` and ``spans``, arrays of ``(kind, start, end)`` by start
    and kind; kinds number ``KINDS``, places are code points, end exclusive.

    ``spans`` has the strong ones and the linked weak ones. Null text is empty. Rows that repeat an id
    with an equal text are one document with the same spans. Other columns are ignored. An empty table
    gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    each = staged(
        keyed(docs, id_col, text_col).mapInArrow(
            _scan, f"doc long, th long, id {id_type}, strong array<{_SPAN}>, weak array<{_SPAN}>"
        )
    )
    parts = (
        each.filter(F.size("weak") > 0)
        .select("doc", "th", F.explode(F.concat("weak", "strong")).alias("span"))
        .select("doc", "th", "span.*")
        .distinct()
        .withColumn("key", F.col("kind").isin(0, 2, 3))
        .withColumn("cells", F.struct(F.floor(F.col("start") / scope).alias("first"), F.floor(F.col("end") / scope).alias("last")))
    )
    # Complementary parts only: a key and an identifier or endpoint.
    left = parts.withColumn("cell", F.explode(F.sequence(F.col("cells.first") - 1, F.col("cells.last") + 1)))
    others = (
        parts.withColumn("cell", F.explode(F.sequence("cells.first", "cells.last")))
        .groupBy("doc", "th", "cell", "key")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind"))).alias("others"))
        .withColumn("key", ~F.col("key"))
    )
    near = F.expr(f"exists(others, o -> greatest(o.start - end, start - o.end) <= {scope} and (kind <> 3 or o.kind <> 5))")
    linked = (
        left.filter(F.col("kind") >= 3)
        .join(others, ["doc", "th", "cell", "key"])
        .filter(near)
        .select("doc", "th", F.struct("kind", "start", "end").alias("span"))
        .groupBy("doc", "th")
        .agg(F.collect_set("span").alias("linked"))
    )
    none = F.array().cast(f"array<{_SPAN}>")
    in_order = "array_sort(spans, (x, y) -> case when x.start <> y.start then cast(sign(x.start - y.start) as int) else x.kind - y.kind end)"
    return (
        each.join(linked, ["doc", "th"], "left")
        .withColumn("spans", F.concat("strong", F.coalesce("linked", none)))
        .select(F.col("id").alias(id_col), "strong", F.expr(in_order).alias("spans"))
    )
