"""Profiling of a wide event table: counts, shares, summaries, histograms, timelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import all_equal, col
from tidemark.functions.fixed_values import UNIT_COLUMNS
from tidemark.operators.blocks import match_keys, running
from tidemark.operators.clean import require_columns, require_set
from tidemark.session import cut_lineage

PREVIEW_COMPLETENESS = 0.6


class MixedUnitsError(Exception):
    """The rows asked for hold more than one unit."""

    def __init__(self, units: list[str]):
        self.units = units
        super().__init__(f"rows hold several units: {units}; add filters")


class EmptyHistogramError(Exception):
    """The rows asked for hold no value."""

    def __init__(self, field: str, filters: Mapping[str, object]):
        self.field = field
        self.filters = dict(filters)
        super().__init__(f"no values of {field} where {dict(filters)}")


class NumericSummary(NamedTuple):
    stats: DataFrame
    unit: str | None


# Ranks are first bracketed by a summary that is off by at most n / _ACCURACY ranks. The brackets reach further,
# by _MARGIN of all ranks, and groups of up to _FEW values are bracketed whole, so a wanted rank is never outside.
_ACCURACY = 10_000
_MARGIN = 0.002
_FEW = 2_000


def exact_quantiles(
    df: DataFrame,
    field: str,
    shares: Sequence[float],
    by: Sequence[str] = (),
    rows_per_block: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles ``q0``, ``q1``, ... per group, or one row without groups.

    The source is read twice: once to bracket the values at the wanted ranks, once to count the values within
    brackets one by one and all others by the gap they fall in. What is ranked is a small part of the values,
    by a running sum that splits over tasks. Groups without values give no row.
    """
    bounds = _bracketed(df, field, shares, by, {})
    chosen = _selected(df, field, shares, by, bounds, rows_per_block)
    return chosen.select(*[col(g) for g in by], *[f"q{i}" for i in range(len(shares))])


def _bracketed(
    df: DataFrame, field: str, shares: Sequence[float], by: Sequence[str], extra: Mapping[str, Column]
) -> DataFrame:
    """Per group ``_n`` values, ``_lows`` and ``_highs`` around the wanted ranks (ascending), and ``extra`` aggregates."""
    value = col(field).cast("double")
    edges = [max(0.0, s - _MARGIN) for s in sorted(shares)] + [min(1.0, s + _MARGIN) for s in sorted(shares)]
    found = df.groupBy(*[col(g) for g in by]).agg(
        F.count(value).alias("_n"),
        F.percentile_approx(value, F.array(*[F.lit(float(e)) for e in edges]), F.lit(_ACCURACY)).alias("_edges"),
        *[aggregate.alias(name) for name, aggregate in extra.items()],
    )
    k = len(shares)
    return cut_lineage(found.withColumns({
        "_lows": F.slice("_edges", 1, k), "_highs": F.slice("_edges", k + 1, k)
    }).drop("_edges"))


def _selected(
    df: DataFrame, field: str, shares: Sequence[float], by: Sequence[str], bounds: DataFrame, rows_per_block: int | None
) -> DataFrame:
    """``bounds`` with ``q0``, ``q1``, ...: the values at the ranks, out of one more read of the source."""
    groups = [col(g) for g in by]
    values = df.select(*groups, col(field).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    edges = bounds.select(*groups, "_n", "_lows", "_highs")
    if by:
        rows = match_keys(values, edges, by, "inner")
    else:
        # One row, as literals.
        n, lows, highs = edges.first()
        listed = lambda xs: F.array(*[F.lit(x) for x in xs or [0.0] * len(shares)])
        rows = values.withColumns({"_n": F.lit(n), "_lows": listed(lows), "_highs": listed(highs)})
    v = F.col("_v")
    inside, gap = F.col("_n") <= _FEW, F.lit(0)
    for i in range(len(shares)):
        low, high = F.get("_lows", F.lit(i)), F.get("_highs", F.lit(i))
        inside = inside | v.between(low, high)
        gap = gap + (v > high).cast("int")
    counted = cut_lineage(
        rows.select(*groups, gap.alias("_gap"), inside.alias("_inside"), F.when(inside, v).alias("_v"))
        .groupBy(*groups, "_gap", "_inside", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    order = ["_gap", "_inside", "_v"]
    ranked = running(counted, by, order, {"_upto": ("sum", F.col("_n"))}, rows_per_block=rows_per_block).drop("_n")
    totals = bounds.select(*groups, (F.col("_n") - 1).alias("_last"))
    ranked = match_keys(ranked, totals, by, "inner") if by else ranked.withColumn("_last", F.lit(n - 1))

    def value_at(rank):
        return F.min(F.when(F.col("_upto") > rank, F.struct(*order)))

    picks, results = [], {}
    for i, share in enumerate(shares):
        place = F.col("_last") * F.lit(float(share))
        picks += [
            value_at(F.floor(place)).alias(f"_low{i}"),
            value_at(F.ceil(place)).alias(f"_high{i}"),
            F.max(place - F.floor(place)).alias(f"_part{i}"),
        ]
        low, high = (
            F.when(F.col(f"_{end}{i}._inside"), F.col(f"_{end}{i}._v")).when(
                F.col(f"_{end}{i}").isNotNull(), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
            )
            for end in ("low", "high")
        )
        results[f"q{i}"] = low + (high - low) * F.col(f"_part{i}")
    found = ranked.groupBy(*groups).agg(*picks).select(*groups, *[r.alias(name) for name, r in results.items()])
    if by:
        return match_keys(found, bounds, by, "inner")
    # Both sides are one row.
    return found.select(*[F.lit(value).cast(bounds.schema[name].dataType).alias(name) for name, value in bounds.drop("_lows", "_highs").first().asDict().items()], *results)


def value_shares(df: DataFrame, field: str) -> DataFrame:
    """Share of rows per value, null included, largest first."""
    counts = df.groupBy(col(field)).agg(F.count(F.lit(1)).alias("_n"))
    # Of the counts, so that the source is read once.
    total = counts.agg(F.sum("_n")).scalar()
    return counts.select(col(field), (F.col("_n") / total).alias("proportion")).orderBy(
        F.desc("proportion"), col(field).asc_nulls_first()
    )


def equal_width_histogram(df: DataFrame, field: str, bins: int = 30) -> DataFrame:
    """Counts per equal-width bin: ``bin``, ``breakpoint`` (upper edge), ``count``.

    Bins are closed on the right, the first on both ends. A single value gets bins around it that
    together are one unit wide.
    """
    values = df.select(col(field).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    ends = values.agg(F.struct(F.min("_v").alias("low"), F.max("_v").alias("high"))).scalar()
    flat = ends.getField("low") == ends.getField("high")
    low = F.when(flat, ends.getField("low") - 0.5).otherwise(ends.getField("low"))
    span = F.when(flat, F.lit(1.0)).otherwise(ends.getField("high") - ends.getField("low"))
    place = F.ceil((F.col("_v") - low) / (span / bins))
    counts = (
        values.select(F.least(F.lit(bins), F.greatest(F.lit(1), place)).cast("bigint").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return (
        df.sparkSession.range(1, bins + 1)
        .withColumnRenamed("id", "bin")
        .join(counts, "bin", "left")
        .select(
            "bin",
            (low + F.col("bin") * (span / bins)).alias("breakpoint"),
            F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        )
        .orderBy("bin")
    )


_QUARTILES = [0.25, 0.5, 0.75]
_SUMMARY = ("count", "null_count", "mean", "std", "min", "p25", "p50", "p75", "max")


def _summary_bounds(df: DataFrame, field: str, extra: Mapping[str, Column]) -> DataFrame:
    """The first read of a description: brackets of the quartiles, and all that needs no ranks."""
    value = col(field).cast("double")
    basic = {
        "count": F.count(value), "null_count": F.count_if(value.isNull()), "mean": F.mean(value),
        "std": F.stddev_samp(value), "min": F.min(value), "max": F.max(value),
    }
    return _bracketed(df, field, _QUARTILES, (), {**basic, **extra})


def _summary(df: DataFrame, field: str, bounds: DataFrame) -> DataFrame:
    """The second read: the quartiles beside what the first one found."""
    found = _selected(df, field, _QUARTILES, (), bounds, None)
    return found.withColumnsRenamed({"q0": "p25", "q1": "p50", "q2": "p75"}).select(*_SUMMARY)


def describe_numbers(df: DataFrame, field: str) -> DataFrame:
    """One row: count, null_count, mean, std, min, quartiles and max, from two reads."""
    return _summary(df, field, _summary_bounds(df, field, {}))


def mostly_complete(df: DataFrame, names: Sequence[str], share: float = PREVIEW_COMPLETENESS) -> DataFrame:
    """Rows whose set columns are strictly more than the given share of ``names``."""
    filled = F.lit(0)
    for name in names:
        filled = filled + col(name).isNotNull().cast("int")
    return df.filter(filled > F.lit(share * len(names)))


class EventProfile:
    """Read-only questions about a wide event table with ``{type}/{field}`` columns."""

    def __init__(self, events: DataFrame):
        require_columns(events, ["patient_id", "event_type"])
        require_set(events, ["patient_id", "event_type"])
        self.events = events

    def _of_type(self, event_type: str) -> DataFrame:
        return self.events.filter(F.col("event_type") == event_type)

    def _slice(self, field: str, filters: Mapping[str, object] | None) -> DataFrame:
        return self._of_type(field.split("/")[0]).filter(all_equal(dict(filters or {})))

    def event_types(self) -> list[str]:
        return [r[0] for r in self.events.select("event_type").distinct().orderBy("event_type").collect()]

    def counts(self) -> DataFrame:
        """Events and patients per event type."""
        return self.events.groupBy("event_type").agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_distinct("patient_id").alias("n_patients"),
        )

    def n_events(self, event_type: str) -> int:
        return self._of_type(event_type).count()

    def n_patients(self, event_type: str) -> int:
        return self._of_type(event_type).agg(F.count_distinct("patient_id")).first()[0]

    def distinct_values(self, names: Sequence[str], filters: Mapping[str, object] | None = None) -> DataFrame:
        """Distinct tuples without nulls, sorted, of the rows the field prefixes point at."""
        rows = self.events
        for name in names:
            if "/" in name:
                rows = rows.filter(F.col("event_type") == name.split("/")[0])
        found = rows.filter(all_equal(dict(filters or {}))).select(*[col(n) for n in names])
        for name in names:
            found = found.filter(col(name).isNotNull())
        return found.distinct().orderBy(*[col(n) for n in names])

    def fields(self, event_type: str) -> list[str]:
        return sorted(c for c in self.events.columns if c.startswith(f"{event_type}/"))

    def field_types(self, event_type: str) -> DataFrame:
        """One row per field: its name and Spark type."""
        rows = [(c, self.events.schema[c].dataType.simpleString()) for c in self.fields(event_type)]
        return self.events.sparkSession.createDataFrame(rows, "field string, dtype string")

    def summarisable_fields(self, event_type: str) -> list[str]:
        """Fields worth a summary: no ids, no dates, no units."""
        dated = (T.DateType, T.TimestampType, T.TimestampNTZType)
        return [
            c
            for c in self.fields(event_type)
            if not c.endswith("_id")
            and not isinstance(self.events.schema[c].dataType, dated)
            and c not in UNIT_COLUMNS
        ]

    def is_numeric(self, field: str) -> bool:
        require_columns(self.events, [field])
        return isinstance(self.events.schema[field].dataType, T.NumericType)

    def describe_categorical(self, field: str) -> DataFrame:
        if self.is_numeric(field):
            raise ValueError(f"{field} is numeric")
        return value_shares(self._of_type(field.split("/")[0]), field)

    def describe_numeric(
        self, field: str, filters: Mapping[str, object], unit_field: str | None = None
    ) -> NumericSummary:
        rows = self._slice(field, filters)
        units = {} if unit_field is None else {"_unit": F.min(col(unit_field)), "_other": F.max(col(unit_field))}
        bounds = _summary_bounds(rows, field, units)
        unit = None
        if units:
            unit, other = bounds.select("_unit", "_other").first()
            if unit != other:
                named = rows.select(col(unit_field)).filter(col(unit_field).isNotNull()).distinct()
                raise MixedUnitsError(sorted(r[0] for r in named.collect()))
        return NumericSummary(_summary(rows, field, bounds), unit)

    def histogram(self, field: str, filters: Mapping[str, object], bins: int = 30) -> DataFrame:
        rows = self._slice(field, filters)
        if rows.filter(col(field).isNotNull()).isEmpty():
            raise EmptyHistogramError(field, filters)
        return equal_width_histogram(rows, field, bins)

    def timeline(self, hadm_id: str) -> DataFrame:
        """All events of one admission in time order."""
        if "timestamp" not in self.events.columns:
            raise ValueError("the events have no timestamp column")
        return (
            self.events.filter(F.col("hadm_id") == hadm_id)
            .select("patient_id", "hadm_id", "event_type", "timestamp")
            .orderBy("timestamp")
        )

    def preview(self, event_type: str, rows: int = 10) -> DataFrame:
        names = self.fields(event_type)
        return mostly_complete(self.events.select(*[col(n) for n in names]), names).limit(rows)
