"""What the operators share: keyed rows, and staged tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.writers import remove_path

NO_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, th, id, text``: a null id counts as the smallest; rows that repeat an id with another
    text are told apart by a hash of the text."""
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("th"),
        F.col(f"`{id_col}`").alias("id"),
        text.alias("text"),
    )


def staging_folder(spark) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only for local sessions without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
        root = tempfile.mkdtemp(prefix="spark-tidemark-")
    return f"{root.rstrip('/')}/staged-{uuid.uuid4().hex}"


# Else Spark keeps them until the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Write ``df``, then each of ``more``, as Parquet to one new folder in the shared one and go on from there. The shuffle files
    of each go when it is written."""
    spark = df.sparkSession
    folder = staging_folder(spark)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        for part in (df, *more):
            part.write.mode("append").parquet(folder)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(folder)


def unstaged(*tables: DataFrame) -> None:
    """Delete the folders of staged tables that nothing reads any more."""
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            remove_path(table.sparkSession, folder)


# A table goes to every executor only if its counted rows take no more than this.
BROADCAST_BYTES = 32 << 20


def sent_if_small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Mark a table (cheap to count) for broadcast if it is small; else Spark joins by shuffle."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
