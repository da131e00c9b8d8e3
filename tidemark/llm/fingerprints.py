"""Document fingerprints: a Merkle tree of sections, paragraphs and sentences. DataFrame functions only.

A paragraph is a line. Its leaves are its sentences (up to ``.``, ``!`` or ``?`` and a space, which belong
to them), each known by 40 bits of its MD5 and its number of code points. A section is a run of paragraphs that
ends where the content says so (after a paragraph whose digest begins with 0 or 1), so that an inserted
paragraph moves no other section's bounds. Digests of paragraphs, sections and the root are MD5 over the
digests below them, with a mark of their level.

Equal roots mean equal texts. Where roots differ, only sections with unknown digests are looked into to
find the paragraphs that were edited (``changed_paragraphs``). How alike two trees are is the share of their
distinct leaves that they have in common, by code points (``likeness``).

Each document's successor in an order of all documents is found with one shuffle of the texts: the order is
cut into blocks (see ``operators.blocks``), and the first document of each block is also sent to the block
before it, where its neighbour is. The block size only decides the parallelism. Rows that are equal in id and
text stay in one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keyed
from tidemark.operators.blocks import cut_tree, place_in_blocks, split_points
from tidemark.session import cut_lineage

SENTENCES = "(?s).*?[.!?] |.+"
# A leaf is a number: 40 bits of the digest above this many bits for its code points.
LENGTH_BITS = 23
_LONGEST = (1 << LENGTH_BITS) - 1

FEWEST_PER_BLOCK, MOST_PER_BLOCK, BLOCKS = 64, 16_384, 4_096


def _digest(level: str, parts: Column) -> Column:
    return F.md5(F.concat(F.lit(level), F.array_join(parts, "")))


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the tree of a text column: ``root`` and ``sections`` of ``digest`` and ``paragraphs``, which have
    a ``digest`` and ``leaves``. Null is an empty text: one paragraph without leaves."""
    sentences = lambda p: F.transform(
        F.regexp_extract_all(p, F.lit(SENTENCES), F.lit(0)),
        lambda s: F.struct(F.md5(s).alias("digest"), F.char_length(s).alias("n")),
    )
    number = lambda s: (
        F.conv(F.substring(s.digest, 1, 10), 16, 10).cast("long") * F.lit(1 << LENGTH_BITS) + F.least(s.n, F.lit(_LONGEST))
    )
    paragraph = lambda p: F.struct(
        _digest("p", F.transform(p, lambda s: s.digest)).alias("digest"), F.transform(p, number).alias("leaves")
    )
    size = F.size("_paragraphs")
    ends = F.filter(
        F.sequence(F.lit(1), size),
        lambda i: (i == size) | F.substring(F.element_at("_paragraphs", i).digest, 1, 1).isin("0", "1"),
    )
    run = lambda e, k: F.slice(
        "_paragraphs",
        F.coalesce(F.get(F.col("_ends"), k - 1), F.lit(0)) + 1,
        e - F.coalesce(F.get(F.col("_ends"), k - 1), F.lit(0)),
    )
    section = lambda s: F.struct(
        _digest("s", F.transform(s, lambda p: p.digest)).alias("digest"), s.alias("paragraphs")
    )
    return (
        df.withColumn("_sentences", F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), sentences))
        .withColumn("_paragraphs", F.transform("_sentences", paragraph)).drop("_sentences")
        .withColumn("_ends", ends)
        .withColumn("_sections", F.transform(F.transform("_ends", run), section)).drop("_paragraphs", "_ends")
        .withColumn(
            name,
            F.struct(_digest("r", F.transform("_sections", lambda s: s.digest)).alias("root"), F.col("_sections").alias("sections")),
        )
        .drop("_sections")
    )


def as_text(tree: Column) -> Column:
    """A tree in one string: the root, ``/`` before each section, ``.`` before each paragraph (8 hex digits of
    their digests each), ``-`` before each leaf."""
    return F.concat(
        tree.root,
        F.array_join(F.transform(tree.sections, lambda s: F.concat(
            F.lit("/"), F.substring(s.digest, 1, 8),
            F.array_join(F.transform(s.paragraphs, lambda p: F.concat(
                F.lit("."), F.substring(p.digest, 1, 8),
                F.array_join(F.transform(p.leaves, lambda x: F.concat(F.lit("-"), F.lower(F.hex(x)))), ""),
            )), ""),
        )), ""),
    )


def distinct_leaves(tree: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(
        F.transform(tree.sections, lambda s: F.transform(s.paragraphs, lambda p: p.leaves))
    )))


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda sum_, x: sum_ + x.bitwiseAND(F.lit(_LONGEST)))


def likeness(root: Column, leaves: Column, other_root: Column, other_leaves: Column) -> Column:
    """1 for equal roots; else below 1: twice the common leaves by those of both, in code points. The
    differing root counts as one."""
    both = _weight(leaves) + _weight(other_leaves) + 1
    return F.when(root == other_root, F.lit(1.0)).otherwise(_weight(F.array_intersect(leaves, other_leaves)) * 2.0 / both)


def changed_paragraphs(tree: Column, other: Column) -> Column:
    """Paragraphs (digests) of ``tree`` that ``other`` does not have, found in the sections it does not have."""
    sections = lambda t, known: F.filter(
        t.sections, lambda s: ~F.array_contains(F.transform(known.sections, lambda k: k.digest), s.digest)
    )
    digests = lambda found: F.flatten(F.transform(found, lambda s: F.transform(s.paragraphs, lambda p: p.digest)))
    return F.array_except(digests(sections(tree, other)), digests(sections(other, tree)))


def seated_in_blocks(docs: DataFrame, rows_per_block: int | None = None) -> DataFrame:
    """Deal rows (``doc, th`` and others) into blocks of the order by (doc, th), as ``_block``. The first row of
    each block also sits, as a ``_guest``, in the block before it, and that of the first block in the last one."""
    order = ["doc", "th"]
    whole = docs.withColumn("_whole", F.lit(0))
    n, low = docs.agg(F.count(F.lit(1)), F.min(F.struct(*order))).first()
    size = rows_per_block or min(MOST_PER_BLOCK, max(FEWEST_PER_BLOCK, n // BLOCKS))
    cuts = cut_lineage(split_points(whole, ["_whole"], order, size))
    n_cuts = cuts.count()
    placed = (
        place_in_blocks(whole, cut_tree(cuts, ["_whole"]), ["_whole"], order, begins="_begins")
        if n_cuts else whole.withColumns({"_block": F.lit(0).cast("long"), "_begins": F.lit(False)})
    )
    smallest = F.lit(False) if low is None else (F.col("doc") == low.doc) & (F.col("th") == low.th)
    before = F.when(F.col("_begins"), F.col("_block") - 1).when(smallest, F.lit(n_cuts))
    seat = lambda block, guest: F.struct(block.alias("block"), F.lit(guest).alias("guest"))
    own = seat(F.col("_block"), False)
    seats = F.when(before.isNull(), F.array(own)).otherwise(F.array(own, seat(before, True)))
    seated = placed.withColumn("_seat", F.explode(seats))
    return seated.withColumns({"_block": F.col("_seat.block"), "_guest": F.col("_seat.guest")}).drop("_seat", "_begins", "_whole").repartition("_block")


def with_next(seated: DataFrame, carried: list[str]) -> DataFrame:
    """Add the ``carried`` columns of the next row as ``next_*``, where next is largest first in (doc, th) and
    after the last comes the first."""
    row = Window.partitionBy("_block").orderBy("_guest", "doc", "th")
    found = seated.withColumns({f"next_{c}": F.lag(c).over(row) for c in carried} | {"_beside": F.lag("_guest").over(row)})
    # The lowest row of a block meets its neighbour as a guest of the block below; a guest's copies do not count.
    met = F.when(F.col("_guest"), ~F.col("_beside")).otherwise(F.col("_beside").isNotNull())
    return found.filter(met).drop("_block", "_guest", "_beside")


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int | None = None
) -> DataFrame:
    """Per row of ``docs``: its id, ``text`` (null is empty), ``tree``, its ``root`` and distinct ``leaves``, and
    ``next_text, next_root, next_leaves`` of the next document in descending order of ids.

    A null id is smaller than all others. Rows that share an id are ordered by a hash of their text; each row
    is one document, also where rows repeat. The last one's next is the first, so a lone document is its own.
    An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    rows = keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    trees = with_tree(seated_in_blocks(rows, rows_per_block), "text", "tree").withColumns({"root": F.col("tree.root"), "leaves": distinct_leaves(F.col("tree"))})
    return with_next(trees, ["text", "root", "leaves"]).withColumnRenamed("id", id_col)
