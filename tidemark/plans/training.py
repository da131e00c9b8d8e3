"""From coded events to labelled, split and tokenised training data. Each job reads and writes
datasets; all inputs are checked before anything is written."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.operators import concepts, folds, landmarks, ordinals, sequences, tokens
from tidemark.session import cut_lineage
from tidemark.sources.readers import read_age_statistics, read_parquet, read_vocabulary_export
from tidemark.sources.writers import (
    require_absent,
    require_present,
    write_new,
    write_rewritten_dataset,
)


def run_concept_map(
    spark: SparkSession,
    events: str,
    dest: str,
    *,
    entries: str,
    vocab_size: int,
    closure: str,
    metadata: str,
    concept: str,
    relationship: str,
    mapping: DataFrame | None = None,
) -> Row:
    """Build the concept map of a dataset's codes and report how many events it covers."""
    require_absent(spark, dest)
    require_present(spark, concept, relationship)
    vocabulary = concepts.load_vocabulary(read_parquet(spark, entries), vocab_size)
    inventory = cut_lineage(concepts.code_inventory(read_parquet(spark, events, ["code"])))
    built = concepts.build_concept_map(
        inventory,
        vocabulary.tokens,
        read_parquet(spark, closure),
        read_parquet(spark, metadata),
        read_vocabulary_export(spark, concept),
        read_vocabulary_export(spark, relationship),
        concepts.curated_mapping(spark) if mapping is None else mapping,
    )
    write_new(built.orderBy("code"), dest)
    return concepts.coverage(spark.read.parquet(dest), inventory).first()


def run_rewrite(
    spark: SparkSession,
    events: str,
    dest: str,
    *,
    concept_map: str,
    concept: str,
    description: Mapping[str, str],
) -> None:
    """Rewrite a dataset's codes to tokens, with its metadata; ``description`` goes into ``dataset.json``."""
    require_absent(spark, dest)
    require_present(spark, concept)
    rows = read_parquet(spark, events)
    mapped = read_parquet(spark, concept_map)
    lookup = concepts.rewrite_lookup(mapped)
    write_rewritten_dataset(
        concepts.rewrite_codes(rows, lookup),
        concepts.code_metadata(lookup, read_vocabulary_export(spark, concept)),
        mapped,
        dest,
        description,
    )


def run_surviving(spark: SparkSession, diagnoses: str, events: str, dest: str) -> Row:
    """Count each diagnosed admission's remaining events; report how many have none."""
    require_absent(spark, dest)
    counted = landmarks.count_surviving_events(
        read_parquet(spark, diagnoses), read_parquet(spark, events, ["visit_id"])
    )
    write_new(counted, dest)
    return spark.read.parquet(dest).agg(
        F.count(F.lit(1)).alias("n_admissions"),
        F.count_if(F.col("n_surviving_events") == 0).alias("n_stranded"),
    ).first()


def run_labels(
    spark: SparkSession,
    events: str,
    diagnoses: str,
    dest: str,
    *,
    step: str = fixed.LANDMARK_STEP,
    horizon: str = fixed.LABEL_HORIZON,
) -> Row:
    """Lay the labelled landmark grid over every inpatient admission; report its counts."""
    require_absent(spark, dest)
    diagnosed = read_parquet(spark, diagnoses)
    rows = read_parquet(spark, events)
    stranded = diagnosed.filter(F.col("n_surviving_events") == 0).count()
    if stranded:
        raise ValueError(f"{stranded} diagnosed admissions kept no events and cannot be used")
    labels = landmarks.labelled_landmarks(rows, diagnosed, step, horizon)
    write_new(labels.orderBy("subject_id", "prediction_time"), dest)
    return landmarks.label_summary(spark.read.parquet(dest)).first()


def run_split(
    spark: SparkSession,
    subjects: str,
    admissions: str,
    diagnoses: str,
    dest: str,
    *,
    fractions: Mapping[str, float] = fixed.FOLD_FRACTIONS,
    seed: int = fixed.FOLD_SEED,
) -> None:
    """Assign every subject to a fold.

    Args:
        spark: the session.
        subjects: events whose subjects are the universe.
        admissions: rewritten events, for the admissions that can be modelled.
        diagnoses: diagnosed admissions.
        dest: the dataset to write.
        fractions: fold -> share of each stratum.
        seed: seed of the subject hash.
    """
    require_absent(spark, dest)
    strata = folds.subject_strata(
        folds.subject_universe(read_parquet(spark, subjects, ["subject_id"])),
        read_parquet(spark, admissions, ["subject_id", "visit_id"]),
        read_parquet(spark, diagnoses),
    )
    write_new(folds.assign_folds(strata, fractions, seed).orderBy("subject_id"), dest)


class SequenceCounts(NamedTuple):
    positions: int
    labels: int
    sequences: int


def run_sequences(
    spark: SparkSession,
    events: str,
    labels: str,
    dest: str,
    *,
    entries: str,
    vocab_size: int,
    length: int,
    stride: int,
    age_mean: float | None = None,
    age_std: float | None = None,
    ages: str | None = None,
    ordinal: str | None = None,
) -> SequenceCounts:
    """Write ``sequences`` and ``labels`` under ``dest`` in one job each, ids unique throughout.

    The mean and standard deviation of ages are given, or read from the table ``ages`` beside the vocabulary.
    ``ordinal`` names the column that orders events sharing a timestamp. Without one, events are numbered
    by their own columns (``ordinals.number_events``).
    """
    require_absent(spark, dest)
    if (ages is None) == (age_mean is None or age_std is None):
        raise ValueError("give either the statistics of ages or the table that holds them")
    if ages is not None:
        age_mean, age_std = read_age_statistics(spark, ages)
    rows = read_parquet(spark, events)
    landmarked = read_parquet(spark, labels)
    vocabulary = concepts.load_vocabulary(read_parquet(spark, entries), vocab_size)

    wanted = sequences.until_last_landmark(rows, landmarked)
    if ordinal is None:
        ordinal = "_ordinal"
        wanted = ordinals.number_events(wanted, ordinal)
    # Read several times below; the files also survive the loss of an executor.
    tokenised = cut_lineage(
        tokens.leaf_tokens(wanted, vocabulary).select("subject_id", "time", "index", ordinal)
    )
    built = sequences.chunk_timelines(
        tokenised,
        sequences.birth_times(wanted),
        length=length,
        stride=stride,
        age_mean=age_mean,
        age_std=age_std,
        ordinal=ordinal,
    )
    write_new(
        built.repartitionByRange("sequence_id").sortWithinPartitions("sequence_id", "position"),
        f"{dest}/sequences",
    )
    written = spark.read.parquet(f"{dest}/sequences")
    write_new(sequences.place_landmarks(written, landmarked), f"{dest}/labels")
    counts = written.agg(F.count(F.lit(1)), F.coalesce(F.max("sequence_id") + 1, F.lit(0))).first()
    return SequenceCounts(counts[0], spark.read.parquet(f"{dest}/labels").count(), counts[1])


class BatchCounts(NamedTuple):
    sequences: int
    pairs: int
    labels: int


def run_batches(
    spark: SparkSession,
    built: str,
    dest: str,
    *,
    entries: str,
    vocab_size: int,
    closure: str,
    batch_size: int,
) -> BatchCounts:
    """Pack what ``run_sequences`` wrote under ``built``: ``sequences``, ``pairs`` and ``labels`` under ``dest``.

    The sequences are gathered once for all three. Rows of ``pairs`` and ``labels`` lie in order of their batch.
    """
    require_absent(spark, dest)
    cells = read_parquet(spark, f"{built}/sequences")
    require_present(spark, f"{built}/labels")
    placed = spark.read.parquet(f"{built}/labels")
    vocabulary = concepts.load_vocabulary(read_parquet(spark, entries), vocab_size)
    expansion = cut_lineage(tokens.ancestor_expansion(vocabulary, read_parquet(spark, closure)))
    packed = sequences.pack_batches(cells, placed, expansion, batch_size)
    counts = []
    for name, part, order in (
        ("sequences", packed.sequences, ("batch", "row")), ("pairs", packed.pairs, ("batch", "flat")), ("labels", packed.labels, ("batch", "flat")),
    ):
        write_new(part.repartitionByRange(*order).sortWithinPartitions(*order), f"{dest}/{name}")
        counts.append(spark.read.parquet(f"{dest}/{name}").count())
    return BatchCounts(*counts)
