"""From raw text columns to typed event columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import fixed_values as fixed
from tidemark.functions.expressions import cleaned_number, col
from tidemark.session import small_side

BASE_COLUMNS = ("patient_id", "event_type", "timestamp")
_TIME_TYPES = (T.TimestampNTZType, T.TimestampType)


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")


def require_types(df: DataFrame, times: Sequence[str] = (), numbers: Sequence[str] = ()) -> None:
    """Refuse a frame whose named columns are not timestamps or not numbers."""
    require_columns(df, [*times, *numbers])
    for name in times:
        if not isinstance(df.schema[name].dataType, _TIME_TYPES):
            raise ValueError(f"{name} must be a timestamp, not {df.schema[name].dataType}")
    for name in numbers:
        if not isinstance(df.schema[name].dataType, T.NumericType):
            raise ValueError(f"{name} must be a number, not {df.schema[name].dataType}")


def require_set(df: DataFrame, names: Sequence[str]) -> None:
    """Refuse a frame with nulls in the named columns (one aggregate over those columns)."""
    require_columns(df, names)
    counts = df.agg(*[F.count_if(col(n).isNull()).alias(n) for n in names]).first()
    bad = [n for n in names if counts[n]]
    if bad:
        raise ValueError(f"null values in {bad}")


def slice_event_type(events: DataFrame, event_type: str) -> DataFrame:
    """Rows of one event type, with the base columns and that type's own columns only."""
    own = [c for c in events.columns if c.startswith(f"{event_type}/")]
    return events.filter(F.col("event_type") == event_type).select(
        *[col(c) for c in (*BASE_COLUMNS, *own)]
    )


def clean_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace text columns by the number they spell (see ``cleaned_number``)."""
    for name in names:
        if not isinstance(df.schema[name].dataType, T.StringType):
            raise TypeError(f"{name} must be text to be cleaned, not {df.schema[name].dataType}")
    return df.withColumns({n: cleaned_number(n) for n in names})


def _small_count(value: Column) -> Column:
    number = value.try_cast("int")
    return F.when(number.between(0, 65535), number)


_PARSERS: dict[str, Callable[[Column], Column] | None] = {
    "String": None,
    "UInt": _small_count,
    "Date": lambda value: F.try_to_date(value, "yyyy-MM-dd"),
    "DateTime": lambda value: F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"),
    "Boolean": lambda value: value.try_cast("tinyint").cast("boolean"),
    "Float": lambda value: value.try_cast("float"),
}


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast text columns as declared; a value that does not parse fails the query."""
    if not df.columns:
        raise ValueError("the frame has no columns")
    if not types:
        raise ValueError("no types were declared")
    casts = {}
    for name, type_name in types.items():
        if name not in df.columns:
            raise ValueError(f"{name} is not a column of the frame")
        if type_name not in _PARSERS:
            raise KeyError(f"{type_name} is not one of {sorted(_PARSERS)}")
        parser = _PARSERS[type_name]
        if parser is not None:
            value = col(name)
            parsed = parser(value)
            complaint = F.concat(F.lit(f"{name} is not a {type_name}: "), value.cast("string"))
            casts[name] = F.when(value.isNull() | parsed.isNotNull(), parsed).otherwise(
                F.raise_error(complaint)
            )
    return df.withColumns(casts)


def describe_coded(df: DataFrame, dictionary: DataFrame, event_type: str) -> DataFrame:
    """Add ``{type}/description`` from a dictionary keyed by code and code version."""
    require_columns(dictionary, ["icd_code", "icd_version", "long_title"])
    require_columns(df, [f"{event_type}/icd_code", f"{event_type}/icd_version"])
    extra = [c for c in dictionary.columns if c not in ("icd_code", "icd_version", "long_title")]
    names = dictionary.select(
        col("icd_version").cast("string").alias(f"{event_type}/icd_version"),
        col("icd_code").cast("string").alias(f"{event_type}/icd_code"),
        col("long_title").alias(f"{event_type}/description"),
        *[col(c) for c in extra],
    )
    return df.join(
        small_side(names), [f"{event_type}/icd_version", f"{event_type}/icd_code"], "left"
    ).select(*[col(c) for c in df.columns], col(f"{event_type}/description"), *[col(c) for c in extra])


def describe_items(df: DataFrame, dictionary: DataFrame, event_type: str) -> DataFrame:
    """Replace ``{type}/itemid`` by ``{type}/description`` from an item dictionary."""
    require_columns(dictionary, ["itemid", "label"])
    item = f"{event_type}/itemid"
    require_columns(df, [item])
    extra = [c for c in dictionary.columns if c not in ("itemid", "label")]
    names = dictionary.select(
        col("itemid").cast("string").alias(item),
        col("label").alias(f"{event_type}/description"),
        *[col(c) for c in extra],
    )
    return df.join(small_side(names), item, "left").select(
        *[col(c) for c in df.columns if c != item],
        col(f"{event_type}/description"),
        *[col(c) for c in extra],
    )


def unify_visit(df: DataFrame) -> DataFrame:
    """Coalesce every ``*/hadm_id`` column into one ``hadm_id``."""
    own = [c for c in df.columns if c.endswith("/hadm_id")]
    if not own:
        return df
    return df.withColumn("hadm_id", F.coalesce(*[col(c) for c in own])).drop(*own)


def canonical_events(
    events: DataFrame,
    event_type: str,
    types: Mapping[str, str],
    coded: DataFrame | None = None,
    items: DataFrame | None = None,
) -> DataFrame:
    """One event type in canonical form: sliced, cleaned, cast, described, one visit column.

    Args:
        events: the wide raw event table.
        event_type: the type to keep.
        types: column -> type name; only this type's columns are used.
        coded: dictionary for types keyed by code and version.
        items: dictionary for types keyed by item id.
    """
    own = {c: t for c, t in types.items() if c.startswith(f"{event_type}/")}
    df = slice_event_type(events, event_type)
    df = clean_numbers(df, [c for c, t in own.items() if t == "Float"])
    if own:
        df = cast_columns(df, own)
    if coded is not None:
        df = describe_coded(df, coded, event_type)
    if items is not None:
        df = describe_items(df, items, event_type)
    return unify_visit(df)


def weights_in_kilograms(weights: DataFrame) -> DataFrame:
    """Convert the rows charted in pounds; drop the item and unit columns."""
    require_columns(weights, ["subject_id", "hadm_id", "stay_id", "itemid"])
    require_types(weights, ["charttime"], ["valuenum"])
    in_pounds = col("itemid") == fixed.WEIGHT_IN_POUNDS_ITEM
    return weights.withColumn(
        "valuenum",
        F.when(in_pounds, col("valuenum") * fixed.POUNDS_TO_KILOGRAMS).otherwise(col("valuenum")),
    ).drop("itemid", "valueuom")


def net_urine(outputs: DataFrame) -> DataFrame:
    """Urine volume per (subject, admission, stay, time), irrigant put in counted negative."""
    require_columns(outputs, ["subject_id", "hadm_id", "stay_id", "itemid"])
    require_types(outputs, ["charttime"], ["valuenum"])
    complete = outputs
    for name in outputs.columns:
        complete = complete.filter(col(name).isNotNull())
    volume = col("valuenum")
    instilled = (col("itemid") == fixed.IRRIGANT_IN_ITEM) & (volume > 0)
    return complete.groupBy("subject_id", "hadm_id", "stay_id", "charttime").agg(
        F.sum(F.when(instilled, -volume).otherwise(volume)).alias("valuenum")
    )
