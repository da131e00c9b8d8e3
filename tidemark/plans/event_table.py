"""The wide event table: built from the raw tables, kept as a dataset, enriched with diagnoses."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import fixed_values as fixed
from tidemark.operators.clean import canonical_events
from tidemark.plans.phenotype import diagnosis_events, load_urine_rate, with_diagnoses
from tidemark.sources.readers import (
    declared_types,
    read_parquet,
    read_raw_table,
    read_text_table,
    stacked,
)
from tidemark.sources.writers import ensure_dataset, fingerprint, stored_state

# Raise when the meaning of the stored columns changes.
EVENT_TABLE_VERSION = 1
DIAGNOSIS_VERSION = 1

CODED_TYPES = ("diagnoses_icd", "procedures_icd")
ITEM_TYPES = ("labevents",)


def canonical_table(
    parts: Mapping[str, DataFrame], tables: Mapping[str, fixed.RawTable], dictionaries: Mapping[str, DataFrame]
) -> DataFrame:
    """The raw events of each type, in text, as one table in canonical form.

    ``dictionaries`` maps an event type to the frame that describes its codes or items.
    """
    types = declared_types(tables)
    return stacked([
        canonical_events(
            part,
            name,
            types,
            coded=dictionaries.get(name) if name in CODED_TYPES else None,
            items=dictionaries.get(name) if name in ITEM_TYPES else None,
        )
        for name, part in parts.items()
    ])


def build_event_table(
    spark: SparkSession,
    root: str,
    dictionaries: Mapping[str, str],
    tables: Mapping[str, fixed.RawTable] = fixed.RAW_TABLES,
) -> DataFrame:
    """All raw tables in canonical form, in one plan.

    ``dictionaries`` maps an event type to the path of the dictionary that describes it.
    """
    return canonical_table(
        {name: read_raw_table(spark, root, name, table) for name, table in tables.items()},
        tables,
        {name: read_text_table(spark, path) for name, path in dictionaries.items()},
    )


def ensure_event_table(
    spark: SparkSession,
    root: str,
    dictionaries: Mapping[str, str],
    path: str,
    tables: Mapping[str, fixed.RawTable] = fixed.RAW_TABLES,
) -> DataFrame:
    """The stored event table, one folder per event type, rebuilt when an input changed."""
    inputs = sorted({f"{root}/{t.path}" for t in tables.values()})
    state = fingerprint(
        spark,
        version=EVENT_TABLE_VERSION,
        sources=inputs,
        settings=tables,
        dictionaries=sorted(dictionaries.values()),
    )
    return ensure_dataset(
        spark, path, state,
        lambda: build_event_table(spark, root, dictionaries, tables),
        partition_by=["event_type"],
    )


def ensure_diagnoses(spark: SparkSession, events_path: str, weights: str, urine: str, path: str) -> DataFrame:
    """The stored diagnosis events; their state includes that of the event table."""
    state = fingerprint(
        spark,
        version=DIAGNOSIS_VERSION,
        sources=[weights, urine],
        upstream=stored_state(spark, events_path),
    )

    def build() -> DataFrame:
        events = read_parquet(spark, events_path)
        rate = load_urine_rate(
            read_parquet(spark, weights), read_parquet(spark, urine), only_in=events
        )
        return diagnosis_events(events, rate)

    return ensure_dataset(spark, path, state, build)


def load_enriched(spark: SparkSession, events_path: str, diagnoses_path: str) -> DataFrame:
    return with_diagnoses(read_parquet(spark, events_path), read_parquet(spark, diagnoses_path))
