"""Running aggregates over ordered keys that stay parallel when one key is huge.

A plain Spark window sends a whole key to one task. Here a heavy key is first cut into blocks,
contiguous in the sort order, and the windows run per (key, block). What earlier blocks add is
one small row per block; it is folded separately and joined back.

Where to cut is read from a sample of rows, ``_DRAWN`` for every block: a key is heavy if it has
two blocks' worth of them, and a cut is made wherever a block's worth has gone by. Rows count, not
distinct places, so a key with many rows at few moments is seen too. The cuts that are used are
written down once, so every reading of the plan and every retry finds the same blocks. Cuts only
decide the parallelism; the result is the same with any of them.

There are as many cuts as the data ask for. They form a tree: a row finds its place among at most
``_FAN`` cuts a level, coarse ones first. A level is broadcast only if its counted size allows;
otherwise the rows of heavy keys are joined to it by (key, coarse place).

Looking for heavy keys reads the key and order columns once while the query is being built. When
there are none, which is the usual case, what is returned is the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import col, count_at_or_below, floor_div
from tidemark.session import cut_lineage, is_small

ROWS_PER_BLOCK = 1_000_000
# Rows drawn for every block: the more, the more even the blocks.
_DRAWN = 16
_SEED = 20
# Cuts in one node of the tree. The list found by a join is copied into every row, so it is short.
_FAN = 64

_EVERYTHING = "_everything"
_LOOK = "look"


@dataclass(frozen=True)
class Level:
    """One level of the tree of cuts: per key and node, the first cuts of its branches."""

    nodes: DataFrame
    small: bool


@dataclass(frozen=True)
class Splits:
    """The heavy keys of a frame and where they are cut, coarsest level first."""

    keys: DataFrame
    levels: tuple[Level, ...]


def split_points(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_block: int | None = None,
) -> DataFrame:
    """The cuts of heavy keys: the key columns, ``_rank`` from 1, and ``_cut``, where a block begins."""
    rows_per_block = rows_per_block or ROWS_PER_BLOCK
    share = min(1.0, _DRAWN / rows_per_block)
    block = share * rows_per_block
    key_cols = [col(k) for k in keys]
    drawn = df.select(*key_cols, F.struct(*[col(o) for o in order]).alias("_cut"))
    if share < 1:
        drawn = drawn.sample(share, _SEED)
    whole = Window.partitionBy(*key_cols)
    ordered = whole.orderBy("_cut")
    begun = F.floor(F.col("_cut_before") / F.lit(block))
    return (
        drawn.groupBy(*key_cols, "_cut").agg(F.count(F.lit(1)).alias("_cut_n"))
        .withColumn("_cut_all", F.sum("_cut_n").over(whole))
        .filter(F.col("_cut_all") >= 2 * block)
        .withColumn("_cut_before", F.sum("_cut_n").over(ordered) - F.col("_cut_n"))
        .withColumn("_cut_begun", begun)
        .withColumn("_cut_last", F.lag("_cut_begun").over(ordered))
        .filter(F.col("_cut_begun") > F.col("_cut_last"))
        .select(*key_cols, "_cut", F.row_number().over(ordered).cast("bigint").alias("_rank"))
    )


def cut_tree(cuts: DataFrame, keys: Sequence[str]) -> Splits:
    """Arrange cuts (see ``split_points``) as a tree in which no node has more than ``_FAN`` branches."""
    key_cols = [col(k) for k in keys]
    deepest = cuts.agg(F.max("_rank")).first()[0] or 0
    entries = cuts.select(*key_cols, (F.col("_rank") - 1).alias("_place"), "_cut")
    levels = []
    while True:
        nodes = cut_lineage(
            entries.groupBy(*key_cols, floor_div(F.col("_place"), _FAN).alias("_node"))
            .agg(F.array_sort(F.collect_list("_cut")).alias("_firsts"))
        )
        levels.append(Level(nodes, is_small(nodes)))
        if deepest <= _FAN:
            break
        deepest = -(-deepest // _FAN)
        entries = nodes.select(*key_cols, F.col("_node").alias("_place"), F.get("_firsts", F.lit(0)).alias("_cut"))
    return Splits(levels[-1].nodes.select(*key_cols), tuple(reversed(levels)))


def heavy_splits(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_block: int | None = None,
) -> Splits | None:
    """Where to cut the heavy keys, or None when no key is heavy. Runs one job over keys and order."""
    cuts = split_points(df, keys, order, rows_per_block)
    return None if cuts.isEmpty() else cut_tree(cut_lineage(cuts), keys)


def match_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, small: bool | None = None
) -> DataFrame:
    """Join on ``keys`` where null equals null. The right side, a cheap one, is broadcast if it is small;
    ``small`` tells if that is known already."""
    renamed = {k: f"_right_{i}" for i, k in enumerate(keys)}
    small = is_small(right) if small is None else small
    right = right.withColumnsRenamed(renamed)
    condition = F.lit(True)
    for key, other in renamed.items():
        condition = condition & col(key).eqNullSafe(F.col(other))
    joined = left.join(F.broadcast(right) if small else right, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*renamed.values())


def join_per_key(
    left: DataFrame, right: DataFrame, keys: Sequence[str], splits: Splits | None
) -> DataFrame:
    """Inner join to a table with one row per key; the heavy keys' rows of it are broadcast if small.

    ``splits`` is what ``heavy_splits`` said of ``left``. The rows of heavy keys are then not shuffled
    by key.
    """
    if splits is None:
        return left.join(right, list(keys))
    top = splits.levels[0].small
    light = match_keys(left, splits.keys, keys, "left_anti", top).join(right, list(keys))
    hot_rows = cut_lineage(match_keys(right, splits.keys, keys, "left_semi", top))
    hot = match_keys(left, splits.keys, keys, "left_semi", top)
    return light.unionByName(
        hot.join(F.broadcast(hot_rows) if is_small(hot_rows) else hot_rows, list(keys))
    )


def place_in_blocks(
    df: DataFrame,
    splits: Splits,
    keys: Sequence[str],
    order: Sequence[str],
    how: str = "left",
    begins: str | None = None,
) -> DataFrame:
    """Add ``_block``, the number of the key's cuts at or below the row; 0 for ordinary keys.

    Args:
        df: any frame.
        splits: where its heavy keys are cut.
        keys: the grouping columns.
        order: the order columns.
        how: ``inner`` keeps the rows of heavy keys only.
        begins: also add, under this name, whether the row stands right at the cut its block begins with.
    """
    here = F.struct(*[col(o) for o in order])
    found = df
    for depth, level in enumerate(splits.levels):
        on = [*keys, "_node"] if depth else list(keys)
        nodes = level.nodes if depth else level.nodes.drop("_node")
        passed = count_at_or_below(F.col("_firsts"), here, _FAN)
        base = F.col("_node") * _FAN if depth else F.lit(0).cast("bigint")
        found = match_keys(found, nodes, on, how if depth == 0 else "left", level.small)
        if level is not splits.levels[-1]:
            place = F.when(F.col("_firsts").isNotNull(), base + F.greatest(passed - 1, F.lit(0)))
            found = found.withColumn("_node", place).drop("_firsts")
            continue
        found = found.withColumn("_block", F.when(F.col("_firsts").isNull(), F.lit(0).cast("bigint")).otherwise(base + passed))
        if begins:
            at = F.when(passed > 0, F.get(F.col("_firsts"), passed - 1))
            found = found.withColumn(begins, F.coalesce(at.eqNullSafe(here) & (passed > 0), F.lit(False)))
    return found.drop("_node", "_firsts")


def _so_far(kind: str, value: Column) -> Column:
    return F.last(value, ignorenulls=True) if kind == "last" else getattr(F, kind)(value)


def _block_total(kind: str, value: Column, order: Sequence[str], reverse: bool) -> Column:
    if kind == "last":
        place = F.when(value.isNotNull(), F.struct(*[col(o) for o in order]))
        return F.min_by(value, place) if reverse else F.max_by(value, place)
    return getattr(F, kind)(value)


def _fold(kind: str, value: Column) -> Column:
    """The aggregate that merges values which are already aggregated."""
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return F.sum(value) if kind == "count" else getattr(F, kind)(value)


def merge(kind: str, here: Column, before: Column) -> Column:
    if kind == "min":
        return F.least(here, before)
    if kind == "max":
        return F.greatest(here, before)
    if kind == "last":
        return F.coalesce(here, before)
    if kind == "bit_xor":
        return F.coalesce(here.bitwiseXOR(before), here, before)
    return F.coalesce(here + before, here, before)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggregates: Mapping[str, tuple[str, Column]],
    *,
    reverse: bool = False,
    exclusive: bool = False,
    group_size: str | None = None,
    rows_per_block: int | None = None,
    splits: Splits | None | str = _LOOK,
) -> DataFrame:
    """Add running aggregates of each key's rows in ascending ``order``.

    Args:
        df: any frame.
        keys: grouping columns; none means one order over the whole frame. Null is a key.
        order: sort columns, ascending. Rows equal in all of them stay in one task, so include
            a tie-break where many rows may share the rest.
        aggregates: new column -> (kind, value), kind being min, max, sum, count, bit_xor or last.
            All kinds pass over null values; ``last`` is the nearest value that is set.
        reverse: run from the end of the order to its start.
        exclusive: leave the row itself out.
        group_size: also add the number of rows of the key, under this name.
        rows_per_block: about how many rows of a heavy key go to one task.
        splits: what ``heavy_splits`` said, if the caller has asked already.
    """
    if not keys:
        whole = df.withColumn(_EVERYTHING, F.lit(0))
        return running(
            whole, [_EVERYTHING], order, aggregates, reverse=reverse,
            exclusive=exclusive, group_size=group_size, rows_per_block=rows_per_block,
        ).drop(_EVERYTHING)

    key_cols = [col(k) for k in keys]
    stop = -1 if exclusive else Window.currentRow

    def windowed(source: DataFrame, partition: list, prefix: str, size: str | None) -> DataFrame:
        group = Window.partitionBy(*partition)
        ordered = group.orderBy(*[col(o).desc() if reverse else col(o).asc() for o in order])
        frame = ordered.rowsBetween(Window.unboundedPreceding, stop)
        columns = {
            prefix + name: _so_far(kind, value).over(frame)
            for name, (kind, value) in aggregates.items()
        }
        if size:
            columns[size] = F.count(F.lit(1)).over(group)
        return source.withColumns(columns)

    if splits is _LOOK:
        splits = heavy_splits(df, keys, order, rows_per_block)
    if splits is None:
        return windowed(df, key_cols, "", group_size)

    # Within the block: the usual window, on its own shuffle by (key, block).
    result = windowed(
        place_in_blocks(df, splits, keys, order).repartition(*key_cols, "_block"),
        [*key_cols, "_block"],
        "_here_",
        "_here_size" if group_size else None,
    )

    # Across blocks: one row per block of the heavy keys only.
    totals = (
        place_in_blocks(df, splits, keys, order, "inner")
        .groupBy(*key_cols, "_block")
        .agg(
            *[
                _block_total(kind, value, order, reverse).alias(f"_total_{name}")
                for name, (kind, value) in aggregates.items()
            ],
            F.count(F.lit(1)).alias("_total_size"),
        )
    )
    per_key = Window.partitionBy(*key_cols)
    step = F.col("_block").desc() if reverse else F.col("_block").asc()
    earlier = per_key.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    carried = cut_lineage(totals.select(
        *key_cols,
        "_block",
        *[
            _fold(kind, F.col(f"_total_{name}")).over(earlier).alias(f"_before_{name}")
            for name, (kind, _) in aggregates.items()
        ],
        F.sum("_total_size").over(per_key).alias("_before_size"),
    ))
    merged = {
        name: merge(kind, F.col(f"_here_{name}"), F.col(f"_before_{name}"))
        for name, (kind, _) in aggregates.items()
    }
    if group_size:
        merged[group_size] = F.coalesce("_before_size", "_here_size")
    joined = match_keys(result, carried, [*keys, "_block"], "left")
    kept = [col(c) for c in df.columns if c not in merged]
    return joined.select(*kept, *[expr.alias(name) for name, expr in merged.items()])


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    *,
    group_size: str | None = None,
    rows_per_block: int | None = None,
    splits: Splits | None | str = _LOOK,
) -> DataFrame:
    """Number each key's rows from zero; ``order`` must be a total order."""
    numbered = running(
        df, keys, order, {name: ("count", F.lit(1))},
        group_size=group_size, rows_per_block=rows_per_block, splits=splits,
    )
    return numbered.withColumn(name, col(name) - 1)
