"""SimHash near-duplicates within two bits, by deletion-variant signatures.

A fingerprint is cut into two segments of 32 bits. Of two fingerprints within two bits, one segment
differs by at most one bit, so it is equal to the other once that bit is blanked. Each distinct
fingerprint is indexed under its 64 variants (segment, blanked bit, what is left), variants are
joined by equality, and pairs are verified by counting the bits that differ.

A variant held by more than ``GROUP`` fingerprints makes no pairs. Its fingerprints are linked
through the 65 points within one bit of each: two fingerprints within two bits share such a point,
two that share one are within two bits, and no more than 65 can share one. That is exact too.

Two bits are far tighter than a similarity of shingles (at 0.8 about ten bits differ). If one is asked for,
texts are besides joined on ``BANDS`` keys of ``ROWS`` minima of their shingles' hashes and verified by the
sets of these hashes. Texts of 0.8 share no key once in 38,000 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, keyed, sent_if_small, staged
from tidemark.llm.components import connected_components
from tidemark.llm.crowds import pairs_across_groups
from tidemark.llm.words import BETWEEN_SPACES, U64, find_words, signed, slices

GROUP = 16
BITS = 2
BANDS, ROWS = 20, 4
TILE = 1000
# So many pairs at least are compared in one round.
ROUND = 100_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def _keys(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each run of hashes."""
    keys = np.zeros((len(begin), BANDS), U64)
    for i in range(BANDS * ROWS):
        mixed = (hashes ^ (np.full(1, i + 1, U64) * ODD)) * ODD
        mixed = (mixed ^ (mixed >> U64(32))) * ODD
        band = keys[:, i // ROWS]
        keys[:, i // ROWS] = (band ^ np.minimum.reduceat(mixed, begin)) * ODD + U64(i)
    return keys


def _fingerprints(width: int, sets: bool = False):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch, data, offsets in slices(batches, "text"):
            words = find_words(data, offsets, BETWEEN_SPACES)
            held = data.tobytes().lower()
            lot = b" ".join(b" ".join(held[s:e].split()) for s, e in zip(offsets[:-1], offsets[1:]) if held[s:e].strip())
            size = words.ends - words.starts
            begin = np.cumsum(size + 1) - size - 1
            counts = words.counts
            shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
            first = np.arange(shingles.sum()) + np.repeat(words.bounds[:-1] - (np.cumsum(shingles) - shingles), shingles)
            last = first + np.repeat(np.minimum(counts, width), shingles) - 1
            ends = begin[last] + size[last]
            hashes = np.fromiter((digest(lot[s:e], 42) for s, e in zip(begin[first].tolist(), ends.tolist())), U64, len(first))
            prints = np.zeros(batch.num_rows, U64)
            some = np.flatnonzero(shingles)
            if len(some):
                bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                ones = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[some], axis=0, dtype=np.int64)
                set_bits = 2 * ones > shingles[some][:, None]
                prints[some] = np.packbits(set_bits, axis=1).view(">u8").ravel().astype(U64)
            columns = {"doc": batch.column("doc"), "th": batch.column("th"), "id": batch.column("id"), "fp": pa.array(signed(prints))}
            if sets:
                begins = np.cumsum(shingles) - shingles
                held_sets: list = [[] for _ in range(batch.num_rows)]
                keys: list = [[] for _ in range(batch.num_rows)]
                for row, own in zip(some.tolist(), _keys(hashes, begins[some]) if len(some) else []):
                    keys[row] = signed(own)
                    held_sets[row] = signed(np.unique(hashes[begins[row]:begins[row] + shingles[row]]))
                columns |= {"keys": pa.array(keys, pa.list_(pa.int64())), "shingles": pa.array(held_sets, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(columns)

    return make


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (key, fp): verified pairs of small groups; ``a`` alone for members of large ones."""
    key = np.zeros(0, np.int64)
    fp = np.zeros(0, U64)
    rank = np.zeros(0, np.int64)
    for batch in batches:
        old = len(key)
        key = np.concatenate((key, batch.column("key").to_numpy()))
        fp = np.concatenate((fp, batch.column("fp").to_numpy().view(U64)))
        at = np.arange(len(key))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begun = np.maximum.accumulate(np.where(new, at, 0))
        # What came before the rows kept from the last batch counts too.
        more = rank[0] if old else 0
        rank = at - begun + np.where(begun == 0, more, 0)
        fresh = at >= old
        pairs = []
        for lag in range(1, GROUP):
            i = np.flatnonzero(fresh & (rank >= lag) & (rank < GROUP))
            a, b = fp[i - lag], fp[i]
            near = np.bitwise_count(a ^ b) <= BITS
            pairs.append(np.stack((a[near], b[near])))
        crossing = np.flatnonzero(fresh & (rank == GROUP))
        large = np.unique(np.concatenate((fp[fresh & (rank >= GROUP)], *(fp[crossing - d] for d in range(1, GROUP + 1)))))
        found = np.unique(np.concatenate((*pairs, np.stack((large, large))), axis=1), axis=1)
        if found.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(signed(found[0])), pa.array(signed(found[1]))], ["a", "b"])
        key, fp, rank = key[-GROUP:], fp[-GROUP:], rank[-GROUP:]


def links_within_two_bits(prints: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints (``fp``) that connect all within two bits."""
    part = F.when(F.col("j") < 32, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    blank = part.bitwiseAND(F.expr("~shiftleft(1L, cast(j % 32 as int))"))
    found = staged(
        prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j"))
        .select((F.col("j").cast("long") * F.lit(1 << 32) + blank).alias("key"), "fp")
        .repartition("key")
        .sortWithinPartitions("key", "fp")
        .mapInArrow(_verified, "a long, b long")
        .distinct()
    )
    flips = F.concat(F.array("fp"), F.expr("transform(sequence(0, 63), j -> fp ^ shiftleft(1L, j))"))
    stars = (
        found.filter("a = b")
        .select(F.col("a").alias("fp"))
        .select("fp", F.explode(flips).alias("point"))
        .withColumn("least", F.min("fp").over(Window.partitionBy("point")))
        .filter("fp <> least")
        .select(F.col("fp").alias("a"), F.col("least").alias("b"))
    )
    return found.filter("a <> b").unionByName(stars).distinct()


def _alike(pairs: DataFrame, each: DataFrame, similarity: float) -> DataFrame:
    """Staged: the fingerprints ``a, b`` of the pairs of texts (``one, two``) whose sets of shingles are alike. Pairs are compared
    in rounds, so that the sets on their way between tasks take no more disk than all sets do, however many pairs there are."""
    rows = pairs.count()
    wanted = pairs.select(F.explode(F.array("one", "two")).alias("th")).distinct()
    sets = staged(each.join(sent_if_small(wanted, 32), "th", "left_semi").select("th", "fp", "shingles").dropDuplicates(["th"]))
    rounds = -(-rows // max(each.count(), ROUND)) or 1
    shared = F.size(F.array_intersect("x", "y"))

    def compared(some: DataFrame) -> DataFrame:
        both = some.join(sets.select(F.col("th").alias("one"), F.col("fp").alias("a"), F.col("shingles").alias("x")), "one").join(
            sets.select(F.col("th").alias("two"), F.col("fp").alias("b"), F.col("shingles").alias("y")), "two"
        )
        return both.filter(shared >= (F.size("x") + F.size("y") - shared) * similarity - 1e-9).select("a", "b").distinct()

    return staged(*[compared(pairs.filter(F.pmod(F.xxhash64("one", "two"), F.lit(rounds)) == at)) for at in range(rounds)])


def links_of_alike_sets(each: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links between fingerprints that connect all texts (``th, fp, keys, shingles``) that share a key and whose sets of
    shingles are alike.

    Texts that share a key are first compared with the next ``GROUP`` - 1 of it and with the first. Of a key that more
    share, all pairs across the groups so found are compared after that, in tiles of about ``TILE`` by ``TILE`` texts.
    """
    texts = staged(each.select("th", "fp", F.size("shingles").alias("n"), "keys").dropDuplicates(["th"]))
    held = staged(
        texts.select("th", "fp", "n", F.posexplode("keys").alias("band", "part"))
        .select("th", "fp", "n", F.xxhash64("band", "part").alias("key"))
        .withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("key")))
        .filter("shared > 1")
    )

    def may_link(one, other) -> Column:
        size = F.least(one("n"), other("n")) >= F.greatest(one("n"), other("n")) * similarity - 1e-9
        return (one("fp") != other("fp")) & size

    def pairs(found: DataFrame) -> DataFrame:
        return staged(found.select(F.least("node", "other_node").alias("one"), F.greatest("node", "other_node").alias("two")).distinct())

    order = Window.partitionBy("key").orderBy("n", "th")
    other = F.struct("th", "fp", "n")
    near = F.concat(
        F.collect_list(other).over(order.rowsBetween(1, GROUP - 1)),
        F.array(F.first(other).over(order.rowsBetween(Window.unboundedPreceding, 0))),
    )
    beside = (
        held.withColumn("others", near)
        .select("th", "fp", "n", F.explode("others").alias("o"))
        .filter(may_link(F.col, F.col("o").getField))
        .select(F.col("th").alias("node"), F.col("o.th").alias("other_node"))
    )
    links = _alike(pairs(beside), each, similarity)
    roots = connected_components(links)
    crowded = (
        held.filter(F.col("shared") > GROUP)
        .join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("key", F.col("th").alias("node"), "fp", "n", F.coalesce("root", "fp").alias("root"))
    )
    across = pairs(pairs_across_groups(crowded, ["fp", "n"], may_link, TILE))
    return links.unionByName(_alike(across, each, similarity)).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None
) -> DataFrame:
    """Per row of ``docs``: its id, ``fp`` (the 64-bit fingerprint as a long), ``component_id``, and the
    keys ``doc, th`` of the row.

    Features are runs of ``width`` words (A-Z in lower case, joined by one space, repeats counted; a
    shorter text is one feature), hashed by XXH64 with seed 42. A bit is set if it is in more than half
    of the features. Null, empty and blank texts have fingerprint zero. Documents whose fingerprints
    differ in at most two bits are linked, and with ``similarity`` also those whose sets of features
    have so large a part in common (intersection by union); ``component_id`` is the smallest id a document is connected
    with. A null id is smaller than all others. An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    each = staged(
        keyed(docs, id_col, text_col).mapInArrow(
            _fingerprints(width, similarity is not None),
            f"doc long, th long, id {id_type}, fp long" + (", keys array<long>, shingles array<long>" if similarity is not None else ""),
        )
    )
    prints = staged(each.groupBy("fp").agg(F.min("doc").alias("least")))
    links = links_within_two_bits(prints.select("fp"))
    if similarity is not None:
        links = links.unionByName(links_of_alike_sets(each, similarity))
    roots = connected_components(links)
    known = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = staged(known)
    smallest = classes.groupBy("root").agg(F.min("least").alias("component"))
    named = staged(classes.join(smallest, "root").select("fp", "component"))
    return each.join(named, "fp").select(
        F.col("id").alias(id_col), "fp", F.expr(f"nullif(component, {NO_ID + 1} - 1)").alias("component_id"), "doc", "th"
    )
