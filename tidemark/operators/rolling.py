"""Aggregates over a trailing stretch of time, in linear time and with sums that do not depend on order.

Time is cut into slots one width long. A row's window is the part of its own slot up to the row plus the
part of the slot before it after ``t - width``: a running aggregate forwards and one backwards, each within
one (key, slot). So a key of any length is spread over its slots, and no window is walked per row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import col, duration_micros, floor_div, micros
from tidemark.operators.blocks import heavy_splits, merge, running
from tidemark.session import cut_lineage

# Doubles are summed as whole numbers, those of every _BIN powers of two by themselves, so that none is lost
# beside a much larger one. A value then has at most 85 bits, which leaves 41 for the number of summed values.
_BIN = 32
_MANTISSA = 52
_WHOLE = "decimal(27,0)"


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    width: str,
    aggregates: Mapping[str, tuple[str, Column]],
    *,
    closed: str = "right",
    rows_per_block: int | None = None,
) -> DataFrame:
    """Add aggregates over ``(t - width, t]`` (closed right) or ``[t - width, t]`` (closed both).

    Rows sharing a timestamp see each other. Kinds are min, max, sum and count; ``at`` must be
    set. Sums of doubles are kept as whole numbers, so they have the same bits however the rows are
    ordered or cut; the range of the values is looked up while the query is being built. If one slot of
    a key is itself too much for a task, its rows are collapsed by moment and cut into blocks.

    Args:
        df: any frame.
        keys: grouping columns; null is a key.
        at: the timestamp column.
        width: a duration such as ``48h``.
        aggregates: new column -> (kind, value).
        closed: which ends of the window count.
        rows_per_block: see ``running``.
    """
    if closed not in ("right", "both"):
        raise ValueError(f"closed must be 'right' or 'both', got {closed!r}.")
    span = duration_micros(width)
    kinds = {name: kind for name, (kind, _) in aggregates.items()}
    values = {name: value for name, (_, value) in aggregates.items()}
    bins = _bins_of_doubles(df, {n: v for n, v in values.items() if kinds[n] == "sum"})
    states = {n: kind for n, kind in kinds.items() if n not in bins}
    parts = {f"_value_{n}": values[n] for n in states}
    for name, found in bins.items():
        # Values that are not finite have no whole form; their sums do not depend on order as they are.
        states[f"{name}_odd"] = "sum"
        parts[f"_value_{name}_odd"] = F.when(~_finite(values[name]), values[name])
        for i, b in enumerate(found):
            states[f"{name}_{i}"] = "sum"
            parts[f"_value_{name}_{i}"] = _as_whole(values[name], b, found[0])
    timed = df.withColumns({"_us": micros(at), **parts}).withColumn("_slot", floor_div(F.col("_us"), span))
    splits = heavy_splits(timed, [*keys, "_slot"], ["_us"], rows_per_block)
    if splits is None:
        found = _at_each_row(timed, df.columns, keys, span, states, closed)
    else:
        moments = _at_each_moment(timed, keys, span, states, closed, rows_per_block)
        found = _join_moments(timed.drop("_slot", *parts), moments, keys)
    result = {n: _put_together(n, bins[n]) if n in bins else col(f"_got_{n}") for n in kinds}
    return found.select(*[col(c) for c in df.columns if c not in result], *[v.alias(n) for n, v in result.items()])


def sum_in_order(df: DataFrame, keys: Sequence[str], at: str, width: str, name: str, value: Column) -> DataFrame:
    """Add the plain sum of doubles over ``[t - width, t]``, added from the earliest row on as SQL engines do.

    ``trailing`` sums exactly, which may differ from this in the last bits. The rows of a window are added anew
    for each row, so it is for windows of few rows. A key is spread over its slots; the rows of the slot before go along.
    """
    span = duration_micros(width)
    timed = df.withColumns({"_us": micros(at), "_value": value}).withColumn("_later", F.explode(F.array(F.lit(0), F.lit(1))))
    slotted = timed.withColumn("_slot", floor_div(F.col("_us"), span) + F.col("_later"))
    window = Window.partitionBy(*[col(k) for k in keys], "_slot").orderBy("_us").rangeBetween(-span, Window.currentRow)
    summed = slotted.withColumn(name, F.sum("_value").over(window)).filter("_later = 0")
    return summed.drop("_us", "_value", "_later", "_slot")


def _finite(value: Column) -> Column:
    return F.abs(value) < F.lit(math.inf)


def _times_two_to(value: Column, power: int) -> Column:
    half = power // 2
    return value * F.lit(2.0 ** half) * F.lit(2.0 ** (power - half))


def _bin(value: Column) -> Column:
    # The guard is on the input: a guard around the whole may be evaluated after what it guards.
    finite = F.when(_finite(value), F.abs(value.cast("double")))
    return F.floor(F.log2(finite) / _BIN).cast("int")


def _as_whole(value: Column, at: int, largest: int) -> Column:
    """The value as a whole number if it belongs to bin ``at``; zero counts to the largest bin."""
    mine = F.when(_finite(value) & (F.coalesce(_bin(value), F.lit(largest)) == at), value.cast("double"))
    return _times_two_to(mine, _MANTISSA - at * _BIN).cast(_WHOLE)


def _put_together(name: str, bins: Sequence[int]) -> Column:
    """The sum of all bins as a double, largest first."""
    sums = [col(f"_got_{name}_{i}") for i in range(len(bins))]
    total = F.lit(0.0)
    for s, b in zip(sums, bins):
        total = total + F.coalesce(_times_two_to(s.cast("double"), b * _BIN - _MANTISSA), F.lit(0.0))
    return F.coalesce(col(f"_got_{name}_odd").cast("double"), F.when(F.coalesce(*sums).isNotNull(), total))


def _bins_of_doubles(df: DataFrame, sums: Mapping[str, Column]) -> dict[str, list[int]]:
    """For each sum of doubles the bins of its values, largest first; a double has about 66 at most."""
    typed = df.select(*[v.alias(n) for n, v in sums.items()]).schema if sums else ()
    floating = [f.name for f in typed if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floating:
        return {}
    found = df.agg(*[F.collect_set(_bin(sums[n])).alias(n) for n in floating]).first()
    return {n: sorted(found[n], reverse=True) or [0] for n in floating}


def _at_each_row(
    timed: DataFrame, columns: Sequence[str], keys: Sequence[str], span: int, states: Mapping[str, str], closed: str
) -> DataFrame:
    """The rows with ``_got_*``: two running windows per (key, slot). A row goes on to the slot before its own as a
    probe at ``t - width`` that carries what it has found so far."""
    slot = Window.partitionBy(*[col(k) for k in keys], "_slot")
    forwards = slot.orderBy("_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = timed.withColumns({f"_own_{n}": getattr(F, kind)(col(f"_value_{n}")).over(forwards) for n, kind in states.items()})
    # Walking backwards, a probe has met exactly the moments after it. At equal time the side decides
    # whether the moment on the edge is met first.
    data_side, probe_side = (0, 1) if closed == "right" else (1, 0)
    value_names = [f"_value_{n}" for n in states]
    nothing = [F.lit(None).cast(timed.schema[c].dataType).alias(c) for c in value_names]
    carried = F.struct(*[col(c) for c in dict.fromkeys([*columns, *[f"_own_{n}" for n in states]])])
    as_data = F.struct(
        F.col("_slot"), F.col("_us"), F.lit(data_side).alias("_side"), *[col(c) for c in value_names],
        F.when(F.lit(False), carried).alias("_row"),
    )
    as_probe = F.struct(
        (F.col("_slot") - 1).alias("_slot"), (F.col("_us") - span).alias("_us"), F.lit(probe_side).alias("_side"),
        *nothing, carried.alias("_row"),
    )
    key_names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    stream = own.select(*[col(k).alias(n) for k, n in key_names.items()], F.explode(F.array(as_data, as_probe)).alias("_either")).select(
        *key_names.values(), "_either.*"
    )
    backwards = (
        Window.partitionBy(*key_names.values(), "_slot").orderBy(F.desc("_us"), F.desc("_side"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    met = stream.withColumns({f"_prev_{n}": getattr(F, kind)(col(f"_value_{n}")).over(backwards) for n, kind in states.items()})
    row = F.col("_row")
    return met.filter(row.isNotNull()).select(
        *[row.getField(c).alias(c) for c in columns],
        *[merge(kind, row.getField(f"_own_{n}"), col(f"_prev_{n}")).alias(f"_got_{n}") for n, kind in states.items()],
    )


def _at_each_moment(
    timed: DataFrame,
    keys: Sequence[str],
    span: int,
    states: Mapping[str, str],
    closed: str,
    rows_per_block: int | None,
) -> DataFrame:
    """``_got_*`` once per (key, ``_us``), without a task per key and slot."""
    key_cols = [col(k) for k in keys]
    in_slot = [*keys, "_slot"]
    # Rows of one moment collapse before the shuffle, however many there are.
    moments = cut_lineage(
        timed.groupBy(*key_cols, "_slot", "_us").agg(
            *[getattr(F, kind)(col(f"_value_{n}")).alias(f"_value_{n}") for n, kind in states.items()]
        )
    )
    kinds = {n: "sum" if kind == "count" else kind for n, kind in states.items()}
    own_slot = cut_lineage(
        running(
            moments, in_slot, ["_us"],
            {f"_own_{n}": (kind, col(f"_value_{n}")) for n, kind in kinds.items()},
            rows_per_block=rows_per_block,
        )
    )
    data_side, probe_side = (0, 1) if closed == "right" else (1, 0)
    data = moments.withColumn("_side", F.lit(data_side))
    probes = own_slot.select(
        *key_cols,
        (F.col("_slot") - 1).alias("_slot"),
        (F.col("_us") - span).alias("_us"),
        F.lit(probe_side).alias("_side"),
        *[f"_own_{n}" for n in kinds],
    )
    met = running(
        data.unionByName(probes, allowMissingColumns=True), in_slot, ["_us", "_side"],
        {f"_prev_{n}": (kind, col(f"_value_{n}")) for n, kind in kinds.items()},
        reverse=True, rows_per_block=rows_per_block,
    )
    return met.filter(F.col("_side") == probe_side).select(
        *key_cols,
        (F.col("_us") + span).alias("_us"),
        *[merge(kind, col(f"_own_{n}"), col(f"_prev_{n}")).alias(f"_got_{n}") for n, kind in kinds.items()],
    )


def _join_moments(rows: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = {k: f"_right_{i}" for i, k in enumerate([*keys, "_us"])}
    condition = F.lit(True)
    for key, other in renamed.items():
        condition = condition & col(key).eqNullSafe(F.col(other))
    return rows.join(values.withColumnsRenamed(renamed), condition, "inner").drop(*renamed.values())
