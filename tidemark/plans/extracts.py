"""Extracts of charted items: the few rows of large charting files that later jobs need, typed and stored."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import fixed_values as fixed
from tidemark.sources.readers import read_urine, read_weights
from tidemark.sources.writers import ensure_dataset, fingerprint

# Raise when the meaning of the stored columns changes.
EXTRACT_VERSION = 1


class Extracts(NamedTuple):
    weights: DataFrame
    urine: DataFrame


def ensure_extracts(spark: SparkSession, charted: str, outputs: str, dest: str, partitions: int = 64) -> Extracts:
    """The stored extracts ``weights`` and ``urine`` under ``dest``; what ``ensure_diagnoses`` reads.

    Args:
        spark: the session.
        charted: the charting file, read once if the weights have to be made.
        outputs: the file of outputs, read once if the urine has to be made.
        dest: the folder of both extracts.
        partitions: over how many tasks the rows that pass are spread; a gzip file is read by one.

    An extract is made again only if its file, its items or its columns changed, and takes the place of the
    old one when it is whole.
    """
    kinds = {
        "weights": (charted, read_weights, (fixed.WEIGHT_ITEMS, fixed.WEIGHT_COLUMNS)),
        "urine": (outputs, read_urine, (fixed.URINE_ITEMS, fixed.URINE_COLUMNS)),
    }
    made = {}
    for name, (path, read, settings) in kinds.items():
        state = fingerprint(spark, version=EXTRACT_VERSION, sources=[path], settings=settings)
        made[name] = ensure_dataset(spark, f"{dest}/{name}", state, lambda: read(spark, path, partitions=partitions))
    return Extracts(**made)
