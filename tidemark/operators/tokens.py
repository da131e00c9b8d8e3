"""From events to vocabulary indices, and from indices to the rows that make up their vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import count_at_or_below
from tidemark.operators.concepts import Vocabulary
from tidemark.session import small_side


def code_lookup(vocabulary: Vocabulary) -> DataFrame:
    """One row per code: its bare index and its bins as two parallel arrays, sorted by start."""
    ordered = F.array_sort(F.collect_list(F.struct("val_start", "index")))
    bins = vocabulary.bins.groupBy("code").agg(ordered.alias("_bins"))
    return bins.join(
        vocabulary.codes.withColumnRenamed("index", "_code_index"), "code", "full"
    ).select(
        "code",
        "_code_index",
        F.col("_bins.val_start").alias("_starts"),
        F.col("_bins.index").alias("_bin_index"),
    )


def leaf_tokens(events: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Add ``index``, the event's token: its value bin, else its text, else its bare code.

    A value belongs to the last bin of its code starting at or below it. Events no token names
    are dropped. Both lookups are no larger than the vocabulary, so events are not shuffled.
    """
    lookup = code_lookup(vocabulary)
    most_bins = lookup.agg(F.max(F.size("_starts"))).first()[0] or 1
    value = F.col("numeric_value").cast("double")
    bin_number = count_at_or_below(F.col("_starts"), value, most_bins)
    texts = vocabulary.texts.select(
        "code", F.col("text").alias("text_value"), F.col("index").alias("_text_index")
    )
    return (
        events.join(small_side(lookup), "code", "left")
        .join(small_side(texts), ["code", "text_value"], "left")
        .withColumn(
            "index",
            F.coalesce(
                F.get("_bin_index", F.coalesce(bin_number, F.lit(0)) - 1),
                F.col("_text_index"),
                F.col("_code_index"),
            ).cast("bigint"),
        )
        .filter(F.col("index").isNotNull())
        .select(*events.columns, "index")
    )


def ancestor_expansion(vocabulary: Vocabulary, closure: DataFrame) -> DataFrame:
    """``index, token``: the rows adding up to each token's vector.

    A bare code takes its own row and those of its ancestors that are bare codes too; a bin or a
    text takes its own row only.
    """
    codes = vocabulary.codes
    own = (
        codes.select("index")
        .unionByName(vocabulary.bins.select("index"))
        .unionByName(vocabulary.texts.select("index"))
        .select("index", F.col("index").alias("token"))
    )
    ancestors = codes.select(F.col("code").alias("ancestor"), F.col("index").alias("token"))
    above = closure.join(codes, "code").join(ancestors, "ancestor").select("index", "token")
    return own.unionByName(above).distinct()


def expand_tokens(events: DataFrame, expansion: DataFrame, position: str = "position") -> DataFrame:
    """``token, position`` pairs: each event fanned out over its rows."""
    return events.join(small_side(expansion), "index").select("token", position)


# Sums per aggregation; wider vectors are summed in stretches of this many dimensions.
_STRETCH = 64


def sum_embeddings(
    pairs: DataFrame,
    table: DataFrame,
    dims: int,
    position: str = "position",
    positions: DataFrame | None = None,
) -> DataFrame:
    """Sum the embedding rows of each position into one array.

    One running sum per dimension combines before the shuffle, so a position shared by very many
    pairs costs no more than any other. A token without a vector, and a vector that is not ``dims``
    long, fail the query when their row is met.

    Args:
        pairs: ``token`` and the position column.
        table: ``token, embedding``.
        dims: length of every embedding.
        position: name of the position column.
        positions: if given, the positions wanted; those without pairs get zeros.
    """
    vector = F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(
        F.raise_error(F.concat(F.lit(f"no vector of {dims} numbers for token "), F.coalesce(F.col("token").cast("string"), F.lit("null"))))
    )
    starts = range(0, dims, _STRETCH)
    stretches = F.array(*[
        F.struct(F.lit(s).alias("start"), F.slice("vector", s + 1, min(_STRETCH, dims - s)).alias("part")) for s in starts
    ])
    sums = (
        pairs.join(small_side(table.select("token", "embedding")), "token", "left")
        .select(position, vector.alias("vector"))
        .select(position, F.inline(stretches))
        .groupBy(position, "start")
        .agg(*[F.sum(F.get("part", F.lit(i)).cast("double")).alias(f"_d{i}") for i in range(min(dims, _STRETCH))])
        .groupBy(position)
        .agg(F.sort_array(F.collect_list(F.struct("start", F.array(*[f"_d{i}" for i in range(min(dims, _STRETCH))]).alias("sums")))).alias("lots"))
        .select(position, F.slice(F.flatten(F.transform("lots", lambda lot: lot.sums)), 1, dims).alias("vector"))
    )
    if positions is None:
        return sums
    zeros = F.array_repeat(F.lit(0.0), dims)
    return positions.select(position).join(sums, position, "left").withColumn(
        "vector", F.coalesce("vector", zeros)
    )
