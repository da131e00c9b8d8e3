"""Reading raw tables, extracts and vocabularies."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions.expressions import col


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet file or folder; a missing or empty one is refused."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no Parquet data at {path}") from error
    return df if columns is None else df.select(*[col(c) for c in columns])


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated file (may be gzipped) with a header, every column as text.

    A row with more or fewer values than the header is refused when it is read. Whole rows are parsed
    for that, whatever columns are asked for.
    """
    return spark.read.option("columnPruning", False).csv(path, header=True, inferSchema=False, escape='"', mode="FAILFAST")


def read_vocabulary_export(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated vocabulary export, every column as text.

    Names in it carry stray quotes, so quoting is off. Ragged rows are refused.
    """
    return spark.read.option("columnPruning", False).csv(
        path, sep="\t", header=True, quote="", inferSchema=False, mode="FAILFAST"
    )


def parse_text_rows(lines: DataFrame, columns: Sequence[str], value: str = "value", sep: str = ",") -> DataFrame:
    """Rows of a delimited file that lie in a frame, one in each ``value``, every column as text.

    For text that arrives as rows (from a queue, an archive, a column). Other columns of ``lines`` stay. As with
    files, a row with more or fewer values than ``columns`` is refused when it is read, and so is a null row.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"mode": "FAILFAST", "sep": sep, "escape": '"'}
    text = F.coalesce(col(value), F.raise_error(F.lit("a row of text is null")).cast("string"))
    rest = [col(c) for c in lines.columns if c != value]
    # All values are read whatever columns are asked for, since a row is bad as a whole.
    return lines.withColumn("_row", F.from_csv(text, schema, options)).select(
        *rest, *[F.col("_row").getField(c).alias(c) for c in columns]
    )


def raw_events(rows: DataFrame, name: str, table: fixed.RawTable, extra: DataFrame | None = None) -> DataFrame:
    """Rows of a raw table as events: ``patient_id, event_type, timestamp`` and ``{name}/{column}``.

    ``extra`` holds the table of the lookup, if the raw table has one.
    """
    if table.lookup is not None:
        if extra is None:
            raise ValueError(f"{name} needs the rows of {table.lookup.path}")
        rows = rows.join(extra.select(table.lookup.on, *table.lookup.columns), table.lookup.on, "inner")
    at = F.lit(None) if table.time is None else col(table.time)
    return rows.select(
        col(table.subject).alias("patient_id"),
        F.lit(name).alias("event_type"),
        at.cast("timestamp_ntz").alias("timestamp"),
        *[col(c).alias(f"{name}/{c}") for c in table.columns],
    )


def read_raw_table(spark: SparkSession, root: str, name: str, table: fixed.RawTable) -> DataFrame:
    """One raw table's files as events (see ``raw_events``)."""
    extra = None if table.lookup is None else read_text_table(spark, f"{root}/{table.lookup.path}")
    return raw_events(read_text_table(spark, f"{root}/{table.path}"), name, table, extra)


def read_age_statistics(spark: SparkSession, path: str) -> tuple[float, float]:
    """Mean and standard deviation of ages in days, stored with a vocabulary as one row ``age_mean, age_std``."""
    rows = read_parquet(spark, path, ["age_mean", "age_std"]).limit(2).collect()
    if len(rows) != 1 or None in tuple(rows[0]) or not rows[0]["age_std"] > 0:
        raise ValueError(f"{path} must hold one row with a mean and a positive standard deviation of ages")
    return float(rows[0]["age_mean"]), float(rows[0]["age_std"])


def read_raw_events(
    spark: SparkSession, root: str, tables: Mapping[str, fixed.RawTable] = fixed.RAW_TABLES
) -> DataFrame:
    """All raw tables stacked into one wide, sparse event table; values are still text."""
    return stacked([read_raw_table(spark, root, name, table) for name, table in tables.items()])


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """Frames one below the other; columns that a frame lacks are null there."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def declared_types(tables: Mapping[str, fixed.RawTable] = fixed.RAW_TABLES) -> dict[str, str]:
    """``{table}/{column}`` -> declared type."""
    return {
        f"{name}/{column}": kind
        for name, table in tables.items()
        for column, kind in table.columns.items()
        if kind is not None
    }


def declared_measures(tables: Mapping[str, fixed.RawTable] = fixed.RAW_TABLES) -> dict[str, fixed.Measure]:
    return {field: m for table in tables.values() for field, m in table.measures.items()}


def item_rows(
    rows: DataFrame, columns: Sequence[str], items: Collection[int], value: str, partitions: int | None = None
) -> DataFrame:
    """Rows of a charting table, in text, whose ``itemid`` is wanted: ids and values typed, other columns gone.

    The few rows that pass are spread again if ``partitions`` is given.
    """
    ids = [c for c in ("subject_id", "hadm_id", "stay_id", "itemid") if c in columns]
    wanted = col("itemid").isin(*[str(i) for i in sorted(items)])
    kept = rows.filter(wanted).select(*[col(c) for c in columns]).withColumns(
        {
            **{c: col(c).cast("bigint") for c in ids},
            "charttime": col("charttime").cast("timestamp_ntz"),
            value: col(value).cast("double"),
        }
    )
    return kept if partitions is None else kept.repartition(partitions)


def read_items(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    items: Collection[int],
    value: str,
    partitions: int | None = None,
) -> DataFrame:
    """``item_rows`` of a charting file. A gzip file is one task however large."""
    return item_rows(read_text_table(spark, path), columns, items, value, partitions)


def read_weights(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    return read_items(spark, path, fixed.WEIGHT_COLUMNS, fixed.WEIGHT_ITEMS, "valuenum", partitions)


def read_urine(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    return read_items(spark, path, fixed.URINE_COLUMNS, fixed.URINE_ITEMS, "value", partitions)
