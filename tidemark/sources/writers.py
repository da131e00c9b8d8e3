"""Writing datasets: never over an existing one, or again only when an input changed."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed


def _path_and_files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, files = _path_and_files(spark, path)
    return files.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    target, files = _path_and_files(spark, path)
    files.delete(target, True)


def require_absent(spark: SparkSession, path: str) -> None:
    if path_exists(spark, path):
        raise FileExistsError(f"{path} exists and is not overwritten")


def require_present(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        if not path_exists(spark, path):
            raise FileNotFoundError(f"nothing at {path}")


def write_new(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write Parquet to a path that must not exist; Spark commits it as a whole."""
    require_absent(df.sparkSession, path)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small text file, replacing what is there; readers see the old or the new one, never a part.

    The bytes go beside the path and are renamed, by the file system that the path names.
    """
    target, files = _path_and_files(spark, path)
    beside, _ = _path_and_files(spark, f"{path}.being-written")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    files.delete(target, True)
    if not files.rename(beside, target):
        raise OSError(f"{path} could not be put in place")


def read_text(spark: SparkSession, path: str) -> str | None:
    if not path_exists(spark, path):
        return None
    return "\n".join(r[0].rstrip("\n") for r in spark.read.text(path, wholetext=True).collect())


def source_state(spark: SparkSession, paths: Sequence[str]) -> list[list[str]]:
    """Number and size of the source files, and digests of their names, sizes and modification times.

    The files are not read. One row comes back, however many files there are.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    each = files.select("path", "length", F.col("modificationTime").cast("string").alias("at"))
    first, second = F.xxhash64("path", "length", "at"), F.xxhash64(F.lit(1), "path", "length", "at")
    row = each.agg(
        F.count(F.lit(1)), F.sum("length"), F.bit_xor(first), F.sum(second.cast("decimal(20,0)"))
    ).first()
    return [[str(v) for v in row]]


def content_hashes(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """SHA-256 of small files such as dictionaries."""
    files = spark.read.format("binaryFile").load(list(paths))
    return {r[0]: r[1] for r in files.select("path", F.sha2("content", 256)).collect()}


def fingerprint(
    spark: SparkSession,
    *,
    version: int,
    sources: Sequence[str] = (),
    settings: object = None,
    dictionaries: Sequence[str] = (),
    upstream: object = None,
) -> dict:
    """Everything a derived dataset depends on, in a form that can be compared and stored."""
    return {
        "version": version,
        "sources": source_state(spark, sources) if sources else [],
        "settings": sha256(repr(settings).encode()).hexdigest(),
        "dictionaries": content_hashes(spark, dictionaries) if dictionaries else {},
        "upstream": upstream,
    }


def ensure_dataset(
    spark: SparkSession,
    path: str,
    state: Mapping[str, object],
    build: Callable[[], DataFrame],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """The dataset at ``path``, rebuilt only when ``state`` is not what it was built from.

    The state lies beside the dataset. A rebuild is written beside the dataset as well and takes its place
    when it is whole; the state is removed before that and written after it. So a build that breaks off
    leaves the old files, and is never taken for a finished one.
    """
    wanted = json.dumps(state, sort_keys=True)
    beside = f"{path}.state"
    if read_text(spark, beside) != wanted or not path_exists(spark, path):
        fresh = f"{path}.being-built"
        remove_path(spark, beside)
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(fresh)
        remove_path(spark, path)
        source, files = _path_and_files(spark, fresh)
        if not files.rename(source, _path_and_files(spark, path)[0]):
            raise OSError(f"{path} could not be put in place")
        write_text(spark, beside, wanted)
    return spark.read.parquet(path)


def stored_state(spark: SparkSession, path: str) -> object:
    """The state a dataset was built from, to nest in the state of what derives from it."""
    text = read_text(spark, f"{path}.state")
    return None if text is None else json.loads(text)


def write_events(df: DataFrame, path: str) -> None:
    """Write coded events ordered by subject and time, births first within their time.

    Files cover ranges of (subject, time), so a subject with very many events spans files.
    """
    require_absent(df.sparkSession, path)
    (
        df.withColumn("_late", F.col("code") != fixed.BIRTH_CODE)
        .repartitionByRange("subject_id", "time", "_late")
        .sortWithinPartitions("subject_id", "time", "_late")
        .drop("_late")
        .write.parquet(path)
    )


def write_rewritten_dataset(
    events: DataFrame,
    metadata: DataFrame,
    concept_map: DataFrame,
    path: str,
    description: Mapping[str, str],
) -> None:
    """Lay out a rewritten dataset: ``data``, ``metadata/codes.parquet``, ``metadata/dataset.json`` (one file
    with ``description``) and the concept map it was made with."""
    spark = events.sparkSession
    require_absent(spark, path)
    write_text(spark, f"{path}/metadata/dataset.json", json.dumps(dict(description), indent=2))
    metadata.orderBy("code").write.parquet(f"{path}/metadata/codes.parquet")
    concept_map.write.parquet(f"{path}/concept_map.parquet")
    write_events(events, f"{path}/data")
