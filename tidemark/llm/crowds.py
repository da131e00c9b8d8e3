"""Pairs of a key that many rows share, without a task that holds the whole key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def pairs_across_groups(
    rows: DataFrame, carried: Sequence[str], may_link: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], tile: int
) -> DataFrame:
    """All pairs (``node, other_node``) of ``rows`` (``key, node, root`` and ``carried``) that share a key, have different
    roots and ``may_link``, which is given the columns of either row by name. A key's rows are dealt to tiles of about
    ``tile``; two tiles meet in one cell. A pair that shares several keys comes as often."""
    key = Window.partitionBy("key")
    dealt = staged(
        rows.withColumn("mixed", F.min("root").over(key) < F.max("root").over(key))
        .withColumn("tiles", F.ceil(F.count(F.lit(1)).over(key) / tile))
        .filter("mixed")
        .withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
        .drop("mixed")
    )
    columns = ["node", "root", *carried]
    one = dealt.withColumn("later", F.explode(F.sequence("tile", F.col("tiles") - 1))).select(
        "key", F.col("tile").alias("low"), F.col("later").alias("high"), *columns
    )
    other = dealt.withColumn("earlier", F.explode(F.sequence(F.lit(0).cast("long"), "tile"))).select(
        "key", F.col("earlier").alias("low"), F.col("tile").alias("high"), *[F.col(c).alias(f"other_{c}") for c in columns]
    )
    apart = (F.col("root") != F.col("other_root")) & ((F.col("low") != F.col("high")) | (F.col("node") < F.col("other_node")))
    met = one.join(other, ["key", "low", "high"]).filter(apart & may_link(F.col, lambda c: F.col(f"other_{c}")))
    return met.select("node", "other_node")
