"""Numbers for the rows of a whole frame, in an order made of their own columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import fixed_values as fixed
from tidemark.functions.expressions import col
from tidemark.operators.blocks import match_keys
from tidemark.session import cut_lineage

_SEED = 7
# Where Spark's row ids keep the place within the partition.
_PLACE_BITS = 33


def number_in_order(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Add ``name``: the row's number from zero in ascending ``order``, null first.

    Rows equal in ``order`` follow their other columns in order of names, so the order is total but for rows
    that are equal throughout, and numbering again gives the same table. (Columns that cannot be
    ordered, maps, decide nothing.)

    Rows are dealt by range, sorted where they land and written down once; a row's number is its place in its
    partition plus the rows of all partitions before it, which takes one small row per partition. Many rows
    that are equal throughout are spread over several partitions.
    """
    taken = {c for c in order if isinstance(c, str)}
    others = [f.name for f in df.schema.fields if f.name not in taken and not isinstance(f.dataType, T.MapType)]
    by = [*[col(c) for c in order], *[col(c) for c in sorted(others)], F.col("_spread")]
    ranged = df.withColumn("_spread", F.rand(_SEED)).repartitionByRange(*by).sortWithinPartitions(*by).drop("_spread")
    placed = cut_lineage(ranged).withColumns({
        "_part": F.spark_partition_id(),
        "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)),
    })
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    numbered = match_keys(placed, starts, ["_part"], "inner")
    return numbered.withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def number_events(events: DataFrame, name: str = "ordinal") -> DataFrame:
    """Number coded events by subject and time, births first within their time, then by code and all other columns.

    The numbers order events that share a timestamp the same way every time, whatever order files are read in.
    """
    late = F.coalesce(F.col("code") != fixed.BIRTH_CODE, F.lit(True))
    return number_in_order(events, ["subject_id", "time", late, "code"], name)
