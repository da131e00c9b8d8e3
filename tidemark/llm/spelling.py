"""Spelling variants: words of the corpus one edit apart, and the form each of them most likely stands for.

The vocabulary is an acceptor A, and E a transducer that inserts, deletes or replaces one symbol. All pairs of
near words are the pairs that A o E o A accepts. The composition is cut into *initial-state partitions*:

- Two words one edit apart, the longer one of m symbols, share either their first m // 2 symbols or, if not,
  their last m // 2. So every word enters four partitions: as one of the longer or one of the shorter words, by
  its beginning or by its end. What is shared is the initial state.
- A partition that holds too many words is split again: what is left between its fixed ends is treated as the
  whole was before. Each split fixes half of what is left, so partitions become small whatever the words are.
  Each pair is accepted in exactly one partition: one that is taken by its end must differ in the beginning.

A task reads whole partitions in order, builds the minimal acceptor of theirs (states are what can still follow,
found from the back), composes it level by level, trims states from which nothing is accepted, and then walks
what is left to enumerate the pairs. A word's number follows from the numbers of words that each arc skips.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.words import LOWER, U64, byte_class, mix, slices

MOST_WORDS = 20_000
_CHUNK = 50_000
_LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))
_TWO_BYTES = byte_class((0x80, 0xBF))
_LEAD = 0xC3
_SYMBOLS = 1 << 22


# ---- Words and how often they occur --------------------------------------------------------------

def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


_CRC = _crc_table()


def _crc32(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of every range of bytes, each going on from a checksum begun before."""
    order = np.argsort(-lengths, kind="stable")
    state, at, left = (begun[order] ^ np.uint32(0xFFFFFFFF)), starts[order], lengths[order]
    longer = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), side="right")
    for step, n in enumerate(longer):
        now = state[:n]
        state[:n] = (now >> np.uint32(8)) ^ _CRC[(now ^ data[at[:n] + step]) & 0xFF]
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _counted(shortest: int, drop_one_in: int | None):
    """Words of slices of texts with their counts. With ``drop_one_in``, a word whose CRC-32 (of id, colon,
    word) it divides loses the symbol that the checksum points at."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            lead = data == _LEAD
            after = np.zeros(len(data), bool)
            after[1:] = lead[:-1] & _TWO_BYTES[data[1:]]
            whole = np.zeros(len(data), bool)
            whole[:-1] = after[1:]
            inside = _LETTERS[data] | after | (lead & whole)
            before = np.zeros(len(data), bool)
            before[1:] = inside[:-1]
            before[offsets[:-1][offsets[:-1] < len(data)]] = False
            begins = inside & ~before
            if not begins.any():
                continue
            # The bytes of words alone, and where each word begins in them.
            held = LOWER[data[inside]]
            starts = np.flatnonzero(begins[inside])
            ends = np.append(starts[1:], len(held))
            symbols = np.add.reduceat(~after[inside], starts, dtype=np.int64)
            places = pa.py_buffer(np.append(starts, len(held)).astype(np.int64))
            words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, places, pa.py_buffer(held)])
            keep = symbols >= shortest
            changed = []
            if drop_one_in:
                row = np.searchsorted(offsets, np.flatnonzero(begins), side="right") - 1
                prefixes = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("id").to_pylist()], np.uint32)
                crc = _crc32(held, starts, ends - starts, prefixes[row])
                hit = crc % drop_one_in == 0
                keep &= ~hit
                at = np.flatnonzero(hit & (symbols > shortest))
                for word, h in zip(words.take(pa.array(at)).to_pylist(), crc[at].tolist()):
                    place = h % len(word)
                    changed.append(word[:place] + word[place + 1:])
            kept = words.filter(pa.array(keep))
            found = pc.value_counts(pa.chunked_array([kept, pa.array(changed, pa.large_string())]))
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])

    return count


def corpus_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, fewest: int = 3, drop_one_in: int | None = None
) -> DataFrame:
    """``word, n``: runs of letters (ASCII and U+00C0 to U+00FF, A-Z in lower case) of at least ``shortest`` code
    points that occur at least ``fewest`` times.

    Null texts have no words, a null id is empty in the checksum. Every row counts, also where rows repeat.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = rows.mapInArrow(_counted(shortest, drop_one_in), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


# ---- The composition -----------------------------------------------------------------------------

def _runs(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """Where the rows of each of ``n`` keys begin in a sorted column, and its end."""
    return np.searchsorted(sorted_keys, np.arange(n + 1))


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range its elements: which range, which element."""
    size = ends - starts
    which = np.repeat(np.arange(len(starts)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + starts[which]


class Acceptor:
    """The minimal acceptor of words of ``depth`` symbols or one less, several initial states side by side.

    ``rows`` (one word each, 0 in place of a missing last symbol) are sorted by initial state and symbols.
    Per level: ``first``, the first word of each prefix; ``state``, its state; and of each state whether it is
    ``final``, where its arcs begin (``arcs``), and its arcs' ``label``, ``target`` and ``skip``.
    """

    def __init__(self, initial: np.ndarray, rows: np.ndarray):
        n, self.depth = rows.shape
        new = np.ones(n, bool)
        new[1:] = initial[1:] != initial[:-1]
        prefix, firsts = [np.cumsum(new) - 1], [np.flatnonzero(new)]
        for d in range(self.depth):
            new = new.copy()
            new[1:] |= rows[1:, d] != rows[:-1, d]
            prefix.append(np.cumsum(new) - 1)
            firsts.append(np.flatnonzero(new))
        self.first = firsts
        self.state, self.final, self.arcs, self.label, self.target, self.skip = ([None] * (self.depth + 1) for _ in range(6))
        last = rows[firsts[-1], self.depth - 1] > 0
        signature = np.where(last, U64(1), U64(0))
        counts = last.astype(np.int64)
        self._states(self.depth, signature, last, np.zeros(1, np.int64), *[np.zeros(0, np.int64)] * 3, alone=True)
        for d in reversed(range(self.depth)):
            child = firsts[d + 1]
            label = rows[child, d].astype(np.int64)
            real = label > 0
            parent = prefix[d][child]
            n_here = len(firsts[d])
            below = np.where(real, mix(signature ^ mix(label.astype(U64))), U64(0))
            sums = np.append(U64(0), np.cumsum(below, dtype=U64))
            bounds = _runs(parent, n_here)
            final = np.zeros(n_here, bool)
            final[parent[~real]] = True
            own = sums[bounds[1:]] - sums[bounds[:-1]] + np.where(final, U64(1), U64(0))
            size = np.where(real, counts, 1)
            before = np.append(0, np.cumsum(size))
            skip = before[:-1] - before[bounds[parent]]
            counts = before[bounds[1:]] - before[bounds[:-1]]
            states = self.state[d + 1]
            keep = np.flatnonzero(real)
            real_bounds = np.searchsorted(keep, bounds)
            self._states(d, own, final, real_bounds, label[keep], states[keep], skip[keep])
            signature = own

    def _states(self, d, signature, final, bounds, label, target, skip, alone=False):
        """Merge prefixes after which the same can follow; a state's arcs are those of its first prefix."""
        _, chosen, state = np.unique(signature, return_index=True, return_inverse=True)
        self.state[d], self.final[d] = state, final[chosen]
        if alone:
            bounds = np.zeros(len(signature) + 1, np.int64)
        which, at = _spread(bounds[chosen], bounds[chosen + 1])
        self.arcs[d] = _runs(which, len(chosen))
        self.label[d], self.target[d], self.skip[d] = label[at], target[at], skip[at]

    def step(self, d: int, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The arc of each state with the given label, or -1."""
        owner = np.repeat(np.arange(len(self.arcs[d]) - 1), np.diff(self.arcs[d]))
        keys = owner * _SYMBOLS + self.label[d]
        if not len(keys):
            return np.full(len(states), -1)
        wanted = states * _SYMBOLS + labels
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)


class _Product:
    """States (p, q, forbidden label) of the composition after the edit, at one level, with what they came from."""

    def __init__(self, p, q, barred):
        self.p, self.q, self.barred = p, q, barred
        self.edits = self.moves = (np.zeros(0, np.int64),) * 4
        self.alive = np.zeros(len(p), bool)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[_Product, list[np.ndarray]]:
    p, q, barred = (np.concatenate(x) for x in zip(*parts))
    if not len(p):
        return _Product(p, q, barred), [p[:0] for _ in parts]
    keys = (p * (q.max() + 1) + q) * (barred.max() + 2) + barred + 1
    _, chosen, index = np.unique(keys, return_index=True, return_inverse=True)
    bounds = np.cumsum([0] + [len(x[0]) for x in parts])
    return _Product(p[chosen], q[chosen], barred[chosen]), [index[a:b] for a, b in zip(bounds, bounds[1:])]


def _compose(a: Acceptor, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that A o E o A pairs: with ``lag`` 0 a symbol is replaced (words of full length, each
    pair once), with 1 one is deleted from the longer word."""
    none = np.zeros(0, np.int64)
    levels: list[_Product | None] = [None] * (a.depth + 1)
    for d in range(a.depth):
        # The edit happens after a common prefix: at a state of level d, which stands for all prefixes that reach it.
        bounds = a.arcs[d]
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        if lag:
            arc, other = np.arange(len(owner)), none
            edit = (a.target[d], owner, a.label[d])
        else:
            arc, other = _spread(np.arange(1, len(owner) + 1), bounds[owner + 1])
            edit = (a.target[d][arc], a.target[d][other], np.full(len(arc), -1))
        # After the edit both words go on with equal symbols. The word that lags is one level up.
        moved, source, arcs = (none, none, none), none, (none, none)
        here = levels[d]
        if here is not None and len(here.p):
            source, up = _spread(a.arcs[d][here.p], a.arcs[d][here.p + 1])
            label = a.label[d][up]
            match = a.step(d - lag, here.q[source], label)
            # Of equal adjacent symbols only the last can be the one deleted.
            good = (match >= 0) & (label != here.barred[source])
            source, up, match = source[good], up[good], match[good]
            moved = (a.target[d][up], a.target[d - lag][match], np.full(len(up), -1))
            arcs = (a.skip[d][up], a.skip[d - lag][match])
        product, (new, old) = _merged([edit, moved])
        if lag:
            product.edits = (owner, new, a.skip[d], np.zeros(len(new), np.int64))
        else:
            product.edits = (owner[arc], new, a.skip[d][arc], a.skip[d][other])
        product.moves = (source, old, *arcs)
        levels[d + 1] = product
    last = levels[-1]
    last.alive = a.final[a.depth][last.p] & a.final[a.depth - lag][last.q]
    for d in range(a.depth, 1, -1):
        source, to = levels[d].moves[:2]
        levels[d - 1].alive[source[levels[d].alive[to]]] = True
    # Walk what is left, with the number of the first word on either side.
    one, two, at = none, none, none
    for d in range(a.depth):
        product = levels[d + 1]
        owner, to, skip_one, skip_two = (x[product.alive[product.edits[1]]] for x in product.edits)
        order = np.argsort(a.state[d], kind="stable")
        reached = _runs(a.state[d][order], len(a.arcs[d]) - 1)
        edit, prefix = _spread(reached[owner], reached[owner + 1])
        first = a.first[d][order[prefix]]
        source, onto, move_one, move_two = (x[product.alive[product.moves[1]]] for x in product.moves)
        order = np.argsort(source, kind="stable")
        out = _runs(source[order], len(levels[d].p) if levels[d] is not None else 0)
        row, move = _spread(out[at], out[at + 1]) if len(at) else (none, none)
        move = order[move]
        one = np.concatenate([first + skip_one[edit], one[row] + move_one[move]])
        two = np.concatenate([first + skip_two[edit], two[row] + move_two[move]])
        at = np.concatenate([to[edit], onto[move]])
    return one, two


def _symbols(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words as a matrix filled up with 0, and their numbers."""
    texts = words.to_pylist()
    wide = np.array(texts, dtype=str)
    width = wide.dtype.itemsize // 4
    return wide.view(np.uint32).reshape(len(texts), width), np.char.str_len(wide).astype(np.int64)


def _near_in(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words, as numbers of rows, in whole partitions of one length and one way of splitting."""
    longest, path = group.column("longest")[0].as_py(), group.column("path")[0].as_py()
    codes, size = _symbols(group.column("word").combine_chunks())
    left = right = 0
    ahead = []
    for turn in path:
        q = (longest - left - right) // 2
        if turn == "L":
            left += q
        else:
            ahead.append((left, left + q))
            right += q
    middle = longest - left - right
    rows = np.zeros((len(codes), middle), np.uint32)
    span = np.minimum(size - left - right, middle)
    for i in range(middle):
        rows[:, i] = np.where(i < span, codes[:, min(left + i, codes.shape[1] - 1)], 0)
    initial = group.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((*rows.T[::-1], initial))
    acceptor = Acceptor(initial[order], rows[order])
    pairs = [np.concatenate(x) for x in zip(_compose(acceptor, 0), _compose(acceptor, 1))]
    one, two = order[pairs[0]], order[pairs[1]]
    keep = np.ones(len(one), bool)
    for first, after in ahead:
        keep &= (codes[one, first:after] != codes[two, first:after]).any(axis=1)
    return one[keep], two[keep]


def _partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole partitions of one length and path, from rows that come in order of those and the key."""
    held, rows = [], 0

    def whole(table: pa.Table) -> Iterator[pa.Table]:
        group = pc.binary_join_element_wise(table.column("longest").cast(pa.string()), table.column("path"), " ")
        codes = group.combine_chunks().dictionary_encode().indices.to_numpy()
        for piece in np.split(np.arange(len(codes)), np.flatnonzero(np.diff(codes)) + 1):
            if len(piece):
                yield table.slice(piece[0], len(piece))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < _CHUNK:
            continue
        table = pa.Table.from_batches(held)
        same = pc.equal(table.column("key"), table.column("key")[-1]).to_numpy()
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield from whole(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = len(same) - cut
    if rows:
        yield from whole(pa.Table.from_batches(held))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _partitions(batches):
        one, two = _near_in(group)
        for first in range(0, len(one), _CHUNK):
            a, b = (group.take(pa.array(x[first:first + _CHUNK])) for x in (one, two))
            columns = [t.column(c).combine_chunks() for t, c in ((a, "word"), (a, "n"), (b, "word"), (b, "n"))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "other", "other_n"])


def near_words(vocabulary: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """``word, n, other, other_n``: all pairs of words of a vocabulary (``word, n``; distinct, of two code points
    at least) that differ by exactly one inserted, deleted or replaced code point, each pair once.

    ``most_words``: partitions of more words than this are split again, as long as they can be.
    """
    length = F.char_length("word")
    words = vocabulary.select("word", "n", F.explode(F.array(length, length + 1)).alias("longest"))

    def keyed(rows: DataFrame) -> DataFrame:
        left, right = F.col("left"), F.col("right")
        return rows.withColumn("key", F.concat_ws(
            "\0", F.col("longest").cast("string"), "path", F.left("word", left), F.right("word", right)
        ))

    def split(rows: DataFrame) -> DataFrame:
        q = F.floor((F.col("longest") - F.col("left") - F.col("right")) / 2).cast("int")
        begun = rows.withColumns({"path": F.concat("path", F.lit("L")), "left": F.col("left") + q})
        ended = rows.withColumns({"path": F.concat("path", F.lit("R")), "right": F.col("right") + q})
        return begun.unionByName(ended)

    start = words.withColumns({"path": F.lit(""), "left": F.lit(0), "right": F.lit(0)})
    rows = keyed(split(start))
    while True:
        can_be_split = F.col("longest") - F.col("left") - F.col("right") >= 2
        crowded = staged(rows.filter(can_be_split).groupBy("key").count().filter(F.col("count") > most_words).select("key"))
        if crowded.isEmpty():
            break
        again = keyed(split(rows.join(crowded, "key", "left_semi").drop("key")))
        rows = staged(rows.join(crowded, "key", "left_anti").unionByName(again))
    dealt = rows.select("word", "n", "longest", "path", "key").repartition("key").sortWithinPartitions("longest", "path", "key")
    return dealt.mapInArrow(_pairs, "word string, n long, other string, other_n long")


def spelling_variants(vocabulary: DataFrame, factor: int = 2, most_words: int = MOST_WORDS) -> DataFrame:
    """Per word of ``vocabulary`` (``word, n``, distinct): ``n``, ``n_near`` (how many words are one edit from it), ``form`` and
    ``form_n`` (the most frequent of those, the smallest in code-point order of equally frequent ones, if it is at
    least ``factor`` times as frequent; else null) and ``root`` (where following forms ends; the word itself if it
    has none). An empty vocabulary gives an empty result."""
    if factor < 2:
        raise ValueError("a form must be at least twice as frequent, so that forms lead nowhere in a circle")
    words = staged(vocabulary.select("word", "n"))
    pairs = near_words(words, most_words)
    sides = F.array(
        F.struct(F.col("word"), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")).alias("best")),
        F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")).alias("best")),
    )
    best = (
        pairs.select(F.explode(sides).alias("side")).select("side.word", "side.best")
        .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    )
    taken = -F.col("best.less") >= F.col("n") * factor
    formed = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"),
    ))
    # Frequencies at least double from form to form, so chains are short; each round doubles the way gone.
    ways = staged(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        gone = staged(ways.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"))
        done = gone.filter("further is not null").isEmpty()
        ways = gone.select("word", "root")
        if done:
            break
    return formed.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
