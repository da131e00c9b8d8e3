"""Session settings and the few helpers that need the session itself."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import col

# A lookup is sent to every executor only after it is known to take no more bytes than this.
BROADCAST_BYTE_LIMIT = 64 << 20


# What the operators expect of any session.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# For clusters and tables of many terabytes: shuffles start out in many partitions and adaptive
# execution merges them to a size that suits an executor, so that one setting serves every query.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(app_name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Open a session; ``conf`` overrides the settings chosen for a local or a cluster master."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    local = master is not None and master.startswith("local")
    settings = {**SESSION_SETTINGS, **({"spark.ui.enabled": "false"} if local else CLUSTER_SETTINGS), **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the files.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a local session
    without that setting falls back to a fresh temporary folder; a cluster session without it
    is refused, because files on one machine do not survive the loss of that machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
            folder = tempfile.mkdtemp(prefix="spark-tidemark-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def held_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` take, summed where they are."""
    width = F.lit(16)
    for field in df.schema.fields:
        name, kind = col(field.name), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(name) + 16
        elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.ArrayType, T.MapType)):
            size = F.size(name) * 16 + 24
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(name)) + 64
        else:
            size = F.lit(8)
        width = width + F.coalesce(size, F.lit(8)).cast("long")
    return df.agg(F.sum(width)).first()[0] or 0


def is_small(df: DataFrame, limit: int = BROADCAST_BYTE_LIMIT) -> bool:
    """Whether ``df`` takes at most ``limit`` bytes; only one number per partition is shuffled."""
    return held_bytes(df) <= limit


def small_side(lookup: DataFrame, limit: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Mark ``lookup`` for broadcast if it really is small, else leave the join to Spark.

    A larger lookup keeps its plain form and is joined by sort-merge, where adaptive execution
    splits skewed partitions.
    """
    return F.broadcast(lookup) if is_small(lookup, limit) else lookup
