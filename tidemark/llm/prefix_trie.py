"""The trie of conversations that begin alike: which prefixes are shared, by how many, and what sharing saves.

A prefix is known by a 128-bit digest: the exclusive or of the hashes of its turns, each mixed with its
depth. So the digest of the prefix one turn shorter follows from a row alone, and the running digest of
a conversation of any length is one running aggregate, which splits long conversations.

1. *Screening.* Every task counts the prefixes of its rows in a count-min sketch with counters that stop
   at two. The sketches are merged block by block. An estimate of one proves that one conversation alone
   has the prefix: such a node is complete where it is, and its row never leaves its task.
2. *Exact grouping.* Only prefixes that may be shared are shuffled and grouped. A wrong suspicion costs one
   row in this shuffle and changes no result.
3. *Subtrees without walking the tree.* A conversation *owns* the nodes of which it is the smallest
   member: those from some depth on. A subtree's leaves are the members that own a childless last node;
   what a subtree saves is, summed over its members, the text from its top down to the depth from which
   the member owns. Both are plain sums over the members of a node.

The sketch has about four cells a row in each of ``ROWS`` rows of cells, at most ``MAX_CELLS`` of them.
That bound is what every task holds and the driver sends (a bit a cell). Beyond about 8 million prefixes
the sketch fills up: fewer singletons are proven and more of the small rows are shuffled, with equal results.

A list of members can only be hashed in its order. Lists are cut into ranges of members which are written
out in parallel; only the finished pieces of a list that spans ranges pass through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.words import U64, mix
from tidemark.operators.blocks import number_rows, running

ROWS = 3
MAX_CELLS = 1 << 25
_BLOCK = 1 << 15
_LOTS = 256
KEY = ["depth", "p1", "p2"]

TRIE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)


def turn_digests(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv, pos, d1, d2, chars``: each turn's place in its conversation from 1, the two halves of the
    digest of its role and text, and the code points of its text.

    Null roles and texts are empty. Turns are ordered by ``turn``, null first, equal ones by their digest.
    Rows without a conversation belong to none and are left out.
    """
    who, said = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    small = conversations.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.xxhash64(F.lit(1), who, said).alias("d1"),
        F.xxhash64(F.lit(2), who, said).alias("d2"),
        F.char_length(said).cast("long").alias("chars"),
    )
    numbered = number_rows(staged(small), ["conv"], ["turn", "d1", "d2"], "pos")
    return numbered.select("conv", (F.col("pos") + 1).alias("pos"), "d1", "d2", "chars")


def continued(turns: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Let every conversation c begin as conversation ``c - c % group`` does: its first h turns, h being the
    CRC-32 of c modulo ``heads``, then c's own turns after its first h.

    Returns the turns as ``conv, depth, d1, d2, chars`` and all conversations as ``conv``; one may have
    no turns left.
    """
    sizes = staged(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    first = F.col("conv") - F.col("conv") % group
    h = F.crc32(F.col("conv").cast("string")) % heads
    convs = (
        sizes.select("conv", first.alias("base"), h.alias("h"))
        .join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    )
    begun = turns.filter(F.col("pos") < heads).withColumnsRenamed({"conv": "base", "pos": "depth"})
    copied = (
        convs.filter("taken > 0").join(begun, "base").filter(F.col("depth") <= F.col("taken"))
        .select("conv", "depth", "d1", "d2", "chars")
    )
    own = (
        turns.join(convs.select("conv", "h", "taken"), "conv").filter(F.col("pos") > F.col("h"))
        .select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "d1", "d2", "chars")
    )
    return copied.unionByName(own), sizes.select("conv")


def _cells(depth: np.ndarray, p1: np.ndarray, p2: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each prefix in each row of the sketch."""
    seed = mix(p1.view(U64) ^ mix(depth.astype(U64)))
    found = []
    for row in range(ROWS):
        seed = mix(seed ^ p2.view(U64) ^ U64(row + 1))
        found.append((seed & U64(cells - 1)).astype(np.int64) + row * cells)
    return found


def _sketch(cells: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.zeros(ROWS * cells, np.uint8) if held is None else held
            for at in _cells(*(batch.column(c).to_numpy() for c in KEY), cells):
                at, times = np.unique(at, return_counts=True)
                held[at] = np.minimum(2, held[at] + np.minimum(times, 2))
        if held is None:
            return
        blocks = held.reshape(-1, min(_BLOCK, cells))
        for first in range(0, len(blocks), 64):
            part = blocks[first:first + 64]
            used = np.flatnonzero(part.any(axis=1))
            if len(used):
                planes = [[np.packbits(part[b] >= times).tobytes() for b in used] for times in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((used + first).astype(np.int32)), pa.array(planes[0], pa.binary()), pa.array(planes[1], pa.binary())],
                    ["block", "once", "twice"],
                )

    return count


def _merged(sketches: pa.Table) -> pa.Table:
    once, twice = np.zeros((2, len(sketches.column("once")[0].as_py())), np.uint8)
    for a, b in zip(sketches.column("once"), sketches.column("twice")):
        seen = np.frombuffer(a.as_py(), np.uint8)
        twice |= np.frombuffer(b.as_py(), np.uint8) | (once & seen)
        once |= seen
    return pa.table({
        "block": sketches.column("block").slice(0, 1),
        "once": pa.array([once.tobytes()], pa.binary()), "twice": pa.array([twice.tobytes()], pa.binary()),
    })


def _crowded_cells(path: DataFrame, cells: int) -> np.ndarray:
    """A bit for every cell that may have met two prefixes or one twice; at most ROWS * MAX_CELLS bits."""
    schema = "block int, once binary, twice binary"
    # Blocks of many tasks are merged in two steps, so that no group holds one block of all tasks.
    parts = path.select(*KEY).mapInArrow(_sketch(cells), schema).withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(_LOTS)))
    lots = parts.groupBy("block", "lot").applyInArrow(_merged, schema)
    bits = np.zeros(ROWS * cells // 8, np.uint8)
    for row in lots.groupBy("block").applyInArrow(_merged, schema).select("block", "twice").toLocalIterator():
        at = row.block * len(row.twice)
        bits[at:at + len(row.twice)] = np.frombuffer(row.twice, np.uint8)
    return bits


def _screened(crowded, cells: int):
    def may_be_shared(depth: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        bits, found = crowded.value, np.ones(len(depth), bool)
        for at in _cells(depth, p1, p2, cells):
            found &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return found

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, p1, p2, q1, q2 = (batch.column(c).to_numpy() for c in (*KEY, "q1", "q2"))
            own = may_be_shared(depth, p1, p2)
            # All conversations share the root.
            above = may_be_shared(depth - 1, q1, q2) | (depth == 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own), pa.array(above)], [*batch.schema.names, "shared", "below_shared"]
            )

    return screen


def _pieces(batches: Iterator[pa.RecordBatch], piece_bytes: int) -> Iterator[pa.RecordBatch]:
    """Members in order of (node, member), as text: a node's whole list if it lies within the rows, else pieces."""
    names = [*KEY, "first", "piece", "whole"]
    key, first, ids, size, open_end, out = None, None, [], 0, True, []

    def close(last: bool):
        # The first and the last node of a task may go on in another one.
        nonlocal ids, size
        if ids:
            out.append((*key, first, ",".join(ids), not (open_end or last)))
        ids, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(names)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for rows in batches:
        for *node, conv in zip(*(rows.column(c).to_numpy().tolist() for c in (*KEY, "conv"))):
            if node != key:
                if key is not None:
                    close(False)
                    open_end = False
                key, first = node, conv
            elif size > piece_bytes:
                open_end = True
                close(False)
                first = conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        yield batch()
        out.clear()
    if key is not None:
        close(True)
    yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order, joined by commas."""
    key, running_hash, out = None, None, []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*KEY, "ends_sha256"])

    for rows in batches:
        for *node, piece in zip(*(rows.column(c).to_pylist() for c in (*KEY, "piece"))):
            if node == key:
                running_hash.update(b",")
            else:
                if key is not None:
                    out.append((*key, running_hash.hexdigest()))
                key, running_hash = node, hashlib.sha256()
            running_hash.update(piece.encode())
        yield batch()
        out.clear()
    if key is not None:
        out.append((*key, running_hash.hexdigest()))
    yield batch()


def hashed_member_lists(members: DataFrame, piece_bytes: int = 1 << 20) -> DataFrame:
    """``depth, p1, p2, ends_sha256`` for rows ``depth, p1, p2, conv``: members in ascending order."""
    ranges = members.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    pieces = staged(ranges.mapInArrow(lambda rows: _pieces(rows, piece_bytes), "depth long, p1 long, p2 long, first long, piece string, whole boolean"))
    done = pieces.filter("whole").select(*KEY, F.sha2("piece", 256).alias("ends_sha256"))
    rest = pieces.filter("not whole").select(*KEY, "first", "piece").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return done.unionByName(rest.mapInArrow(_hashed, "depth long, p1 long, p2 long, ends_sha256 string"))


def _sha_of(text: Column) -> Column:
    return F.sha2(text, 256)


def prefix_trie(turns: DataFrame, convs: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per distinct prefix of the conversations, from the textless root down.

    Args:
        turns: ``conv, depth, d1, d2, chars``: the turns of each conversation, depths from 1 without gaps.
        convs: ``conv``: all conversations, also those without turns. Rows may repeat.
        max_cells: bound on the cells in each row of the sketch, a power of two.

    Returns ``conv_id`` (the smallest member), ``depth, parent_conv_id`` (null for the root), ``n_convs,
    n_children, n_leaves`` (childless nodes in the subtree), ``saved_tokens`` (over the subtree, members
    but one times the code points of the node's last text) and ``ends_sha256`` (of the ids of the members that
    end here, ascending, joined by commas). A subtree includes its top. Without any conversation there is no
    row. The trie of conversations without turns is its root.
    """
    spark = turns.sparkSession
    convs = staged(convs.distinct())
    everyone = convs.agg(F.count(F.lit(1)), F.min("conv")).first()
    if not everyone[0]:
        return spark.createDataFrame([], TRIE)
    mixed = staged(turns.select(
        "conv", "depth", "chars",
        F.xxhash64("d1", "depth").alias("t1"), F.xxhash64("d2", F.lit(3), "depth").alias("t2"),
    ))
    path = staged(running(
        mixed, ["conv"], ["depth"],
        {"p1": ("bit_xor", F.col("t1")), "p2": ("bit_xor", F.col("t2")), "upto": ("sum", F.col("chars"))},
        group_size="n_turns",
    ).select(
        "conv", "depth", "n_turns", "chars", "upto", "p1", "p2",
        F.col("p1").bitwiseXOR(F.col("t1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("t2")).alias("q2"),
    ))
    n = path.count()
    cells = min(max_cells, max(_BLOCK, 1 << (4 * n).bit_length()))
    crowded = spark.sparkContext.broadcast(_crowded_cells(path, cells))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in path.schema.fields)
    rows = staged(path.mapInArrow(_screened(crowded, cells), f"{types}, shared boolean, below_shared boolean"))
    singles, members = rows.filter("not shared"), rows.filter("shared")

    # Nodes that may be shared, each with its owner; children are counted at their parents' keys.
    nodes = staged(members.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("owner"), F.min("q1").alias("q1"), F.min("q2").alias("q2")
    ))
    parent = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = staged(
        nodes.select(*parent).unionByName(singles.filter("below_shared").select(*parent))
        .groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    )
    nodes = staged(
        nodes.select(*KEY, "n_convs", "owner").join(children, KEY, "left").fillna(0, ["n_children"])
    )
    met = staged(members.join(nodes.select(*KEY, "owner", "n_children"), KEY))
    foreign = F.when(F.col("owner") != F.col("conv"), F.col("depth"))
    childless = (F.col("owner") == F.col("conv")) & (F.col("n_children") == 0)
    # Per conversation: the last node it does not own, and whether its last node is a leaf of its own.
    owners = staged(met.groupBy("conv").agg(
        F.coalesce(F.max(foreign), F.lit(0)).alias("foreign"),
        F.coalesce(F.max_by("upto", foreign), F.lit(0)).alias("foreign_upto"),
        F.max_by("owner", foreign).alias("above"),
        F.coalesce(F.max(F.when(F.col("depth") == F.col("n_turns"), childless.cast("long"))), F.lit(1)).alias("leaf"),
    ))
    not_owned = F.greatest(F.lit(0), F.col("foreign_upto") - F.col("upto") + F.col("chars"))
    sums = (
        met.select("conv", *KEY, "upto", "chars").join(owners.select("conv", "foreign", "foreign_upto", "leaf"), "conv")
        .groupBy(*KEY)
        .agg(
            F.sum(F.when(F.col("depth") <= F.col("foreign"), not_owned).otherwise(0)).alias("saved_tokens"),
            F.sum("leaf").alias("n_leaves"),
        )
    )
    turnless = convs.join(rows.filter("depth = 1").select("conv"), "conv", "left_anti")
    zero = F.lit(0).cast("long")
    ends = staged(hashed_member_lists(
        members.filter(F.col("depth") == F.col("n_turns")).select(*KEY, "conv")
        .unionByName(turnless.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv"))
    ))
    nothing = _sha_of(F.lit(""))
    first_of_all = F.lit(everyone[1]).cast("long")
    above = owners.select(F.col("conv").alias("conv_id"), "foreign", F.coalesce("above", first_of_all).alias("above"))
    parent_of = F.when(F.col("depth") == F.coalesce("foreign", F.lit(0)) + 1, F.coalesce("above", first_of_all)).otherwise(F.col("conv_id"))

    shared = (
        nodes.join(sums, KEY).join(ends.filter("depth > 0"), KEY, "left")
        .withColumnRenamed("owner", "conv_id").join(above, "conv_id", "left")
        .select(
            "conv_id", "depth", parent_of.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )
    last = F.col("depth") == F.col("n_turns")
    alone = singles.withColumnRenamed("conv", "conv_id")
    # The first node of a tail hangs on a node of others; all below it are complete as they are.
    heads = alone.filter("below_shared").join(above, "conv_id", "left").withColumn("parent_conv_id", parent_of)
    tails = alone.filter("not below_shared").withColumn("parent_conv_id", F.col("conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_turns"]
    one = F.lit(1).cast("long")
    single = heads.select(*columns).unionByName(tails.select(*columns)).select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(last, _sha_of(F.col("conv_id").cast("string"))).otherwise(nothing).alias("ends_sha256"),
    )
    return _root(spark, everyone, rows, children, owners, ends).unionByName(shared).unionByName(single)


def _root(spark: SparkSession, everyone, rows: DataFrame, children: DataFrame, owners: DataFrame, ends: DataFrame) -> DataFrame:
    """The row of all conversations, from one number of each table."""
    n_convs, smallest = everyone
    below = children.filter("depth = 0").agg(F.sum("n_children")).first()[0] or 0
    talking = rows.filter("depth = 1").count()
    met, leaves, saved = owners.agg(F.count(F.lit(1)), F.sum("leaf"), F.sum("foreign_upto")).first()
    # A conversation without a prefix that may be shared ends in a leaf of its own.
    leaves = (leaves or 0) + talking - met if below else 1
    listed = ends.filter("depth = 0").select("ends_sha256").first()
    sha = listed[0] if listed else hashlib.sha256(b"").hexdigest()
    return spark.createDataFrame([(smallest, 0, None, n_convs, below, leaves, saved or 0, sha)], TRIE)
