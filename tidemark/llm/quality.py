"""Quality rules: statistics of each document, plain rules, and an isolation forest over the statistics.

The forest is grown from a bounded sample (``pool`` documents, the ones with the smallest hashes of
their ids): each tree splits ``sample`` of them at random, and what is split off early is rare. Few
documents per tree keep crowds of like anomalies from hiding each other. All documents are scored by their mean path length. The threshold is calibrated on all labelled
documents: a histogram of scores by label is summed in Spark, and the threshold is the one that rejects
the most bad documents while it rejects at most ``max_loss`` of the good ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, staged
from tidemark.llm.words import BETWEEN_SPACES, U64, Grams, byte_class, find_words, mix, slices, starts_of_runs

SYMBOLS = byte_class(*((ord(c), ord(c)) for c in "#*$%&|<>"))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RUN = 8
BINS = 1000


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches, "text"):
        words = find_words(data, offsets, BETWEEN_SPACES)
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        length = np.concatenate(([0], np.cumsum(points[words.ends] - points[words.starts])))
        symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
        held = data.tobytes()
        lines = np.zeros(batch.num_rows, np.int64)
        for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            lot = [x for x in held[s:e].split(b"\n") if x and not x.isspace()]
            lines[i] = len(lot) - len(set(lot))
        # Runs of words found twice in one document.
        at = starts_of_runs(words, RUN)
        row = np.searchsorted(words.bounds, at, side="right") - 1
        hashes = mix(Grams(words).of(at, at + RUN) ^ mix(row.astype(U64)))
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        change = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(change, at[twice], 1)
        np.add.at(change, at[twice] + RUN, -1)
        repeat = np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) > 0)))
        first, after = words.bounds[:-1], words.bounds[1:]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("th"), batch.column("id"), pa.array(words.counts.astype(np.int64)),
             pa.array((length[after] - length[first]).astype(np.int64)),
             pa.array((symbols[offsets[1:]] - symbols[offsets[:-1]]).astype(np.int64)), pa.array(lines),
             pa.array((repeat[after] - repeat[first]).astype(np.int64))],
            ["doc", "th", "id", *COUNTS],
        )


def features(counts: list[np.ndarray]) -> np.ndarray:
    """What the forest splits on: shares that do not grow with a document's length."""
    n, chars, symbols, lines, repeats = (c.astype(np.float64) for c in counts)
    words = np.maximum(n, 1)
    return np.stack((chars / words, symbols / words, lines / np.sqrt(words), repeats / words), axis=1)


class IsolationForest:
    """Trees of random splits, kept as arrays; scores near 1 are anomalies."""

    def __init__(self, rows: np.ndarray, trees: int, sample: int, seed: int):
        random = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.height = int(np.ceil(np.log2(max(2, self.sample)))) + 2
        self.trees = [self._grow(rows[random.choice(len(rows), self.sample, replace=False)], random) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, random: np.random.Generator):
        column, cut, left, right, depth = [], [], [], [], []

        def node(part: np.ndarray, level: int) -> int:
            here = len(column)
            for lot, value in ((column, -1), (cut, 0.0), (left, here), (right, here), (depth, level + average_path(len(part)))):
                lot.append(value)
            low, high = part.min(axis=0), part.max(axis=0)
            open_columns = np.flatnonzero(high > low)
            if level < self.height and len(part) > 1 and len(open_columns):
                c = int(random.choice(open_columns))
                value = float(random.uniform(low[c], high[c]))
                column[here], cut[here] = c, value
                left[here] = node(part[part[:, c] <= value], level + 1)
                right[here] = node(part[part[:, c] > value], level + 1)
            return here

        node(rows, 0)
        return np.array(column), np.array(cut), np.array(left), np.array(right), np.array(depth)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for column, cut, left, right, depth in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.height + 1):
                c = column[at]
                goes = np.where(rows[np.arange(len(rows)), np.maximum(c, 0)] <= cut[at], left[at], right[at])
                at = np.where(c < 0, at, goes)
            total += depth[at]
        return 2.0 ** (-total / max(1, len(self.trees)) / max(average_path(self.sample), 1e-9))


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else float(max(0, n - 1))


def _scored(forest: IsolationForest):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features([batch.column(c).to_numpy() for c in COUNTS])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc", "th", "id", *COUNTS)), pa.array(forest.score(rows))],
                ["doc", "th", "id", *COUNTS, "score"],
            )

    return score


def threshold(histogram: list[tuple[int, int, int]], max_loss: float) -> float:
    """The score from which documents are rejected, from (bin, good, bad) of all labelled ones.

    Without labels of either kind nothing is rejected. Otherwise bins are taken from the top while the
    share of good documents lost stays within ``max_loss``, and only as far down as they still gain
    more of the bad ones than they lose of the good ones.
    """
    good, bad = sum(h[1] for h in histogram), sum(h[2] for h in histogram)
    best, cut, lost, caught = 0.0, float("inf"), 0, 0
    for bin_, g, b in sorted(histogram, reverse=True):
        lost, caught = lost + g, caught + b
        if not good or not bad or lost > max_loss * good:
            break
        gain = caught / bad - lost / good
        if gain > best:
            best, cut = gain, bin_ / BINS
    return cut


def judge_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
    quality_col: str = "quality", trees: int = 300, sample: int = 12, pool: int = 25_600, max_loss: float = 0.005, seed: int = 5,
) -> DataFrame:
    """Per row of ``docs``: its id, the five ``COUNTS``, ``base_failed``, ``score``, ``kept`` and the keys
    ``doc, th`` of the row.

    Words stand between ASCII white space. A text of fewer than 20 words, or with more than 30 % of its
    words in runs of eight found twice, fails at once; the forest is grown, calibrated and asked on the
    others. A label is 1 for good, 0 for bad; other and null labels are left out. Null text is empty. A
    document labelled twice counts twice. Without labels of both kinds nothing more is rejected. Other
    columns are ignored. An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    each = staged(
        keyed(docs, id_col, text_col).mapInArrow(_statistics, f"doc long, th long, id {id_type}, {counts}")
    ).withColumn("base_failed", failed)
    able = each.filter(~F.col("base_failed"))
    # One share of about twice the pool by hash, so that no more than that goes anywhere.
    shares = max(1, able.count() // (2 * pool))
    drawn = (
        able.filter(F.pmod(F.xxhash64("doc", "th", F.lit(-seed)), F.lit(shares)) == 0)
        .orderBy(F.xxhash64("doc", "th", F.lit(seed)), "doc", "th")
        .limit(pool)
        .select(*COUNTS)
        .toPandas()
    )
    if len(drawn):
        forest = IsolationForest(features([drawn[c].to_numpy() for c in COUNTS]), trees, sample, seed)
        scored = staged(
            each.drop("base_failed").mapInArrow(_scored(forest), f"doc long, th long, id {id_type}, {counts}, score double")
        ).withColumn("base_failed", failed)
    else:
        scored = each.withColumn("score", F.lit(0.0))
    known = labels.select(
        F.col(f"`{label_id_col}`").cast("long").alias("doc"), F.col(f"`{quality_col}`").cast("int").alias("quality")
    ).filter(F.col("quality").isin(0, 1))
    histogram = (
        scored.filter(~F.col("base_failed"))
        .select("doc", F.floor(F.col("score") * BINS).cast("int").alias("bin"))
        .join(known, "doc")
        .groupBy("bin")
        .agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
        .collect()  # no more rows than bins
    )
    cut = threshold([(r.bin, r.good, r.bad) for r in histogram], max_loss)
    rejected = F.col("base_failed") | (F.floor(F.col("score") * BINS) / BINS >= F.lit(cut))
    return scored.select(
        F.col("id").alias(id_col), *COUNTS, "base_failed", "score", (~rejected).alias("kept"), "doc", "th"
    )
