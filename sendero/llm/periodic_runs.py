"""Periodic runs of words, by recompression.

A run is a stretch of consecutive words that repeats itself: with smallest period q it has at least
``max(6, 4 * q)`` words, and no neighbouring word continues the period. All runs of a text are found:

* A run of period q holds four neighbouring multiples of q, where its words are equal. So equal words on
  the grid of multiples of q, for every q, give all candidates; that is n/1 + n/2 + n/3 + ... comparisons.
* A run-length grammar of the texts with candidates is made by recompression: blocks of equal symbols
  become one symbol, then pairs of a left and a right symbol become one, in turn, until each text is one
  symbol. Equal stretches are parsed alike but for their ends, so the longest common extension of two
  places climbs while their symbols agree and descends where they differ, with a few comparisons a level.
* The extensions to both sides of (place, place + q) give the exact run. Two periods that give the same
  stretch are multiples of its smallest one.

Words are numbered by their bytes, not by hashes. Memory follows a slice of texts or the longest text.

Nulls and texts without words have no runs. A null doc_id is carried and never planted. Repeated rows get
equal results. Other columns are dropped. An empty table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import NOT_SPACE, Texts, Words, in_arrow, mix, ragged, slices, spread, words_of

LEAST_WORDS = 6
LEAST_EXPONENT = 4
QUERIES = 1 << 20  # extensions asked at once
SLICE = 1 << 20

SCHEMA = (
    "doc_id bigint, n_words bigint, run_start array<bigint>, run_length array<bigint>, run_period array<bigint>, "
    "collapsed string"
)


# --- grammar


class Level(NamedTuple):
    """Symbols of a level; symbol k stands for the symbols first[k] to first[k + 1] - 1 of the level below."""

    symbol: np.ndarray
    first: np.ndarray | None  # None on the lowest level
    parent: np.ndarray | None  # the symbol above each symbol; None on the highest level


def _renamed(symbols: np.ndarray, joined: np.ndarray, keys: tuple[np.ndarray, np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Names of the next level: those of joined symbols are new, the same for equal keys."""
    names = symbols[starts]
    _, number = np.unique((keys[0] << 32) | keys[1], return_inverse=True)
    names[joined] = symbols.max(initial=-1) + 1 + number
    return names


def _blocks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(first, names) with each maximal block of equal symbols as one symbol; None where there is no block."""
    change = np.ones(len(symbols), bool)
    change[1:] = symbols[1:] != symbols[:-1]
    starts = np.flatnonzero(change)
    if len(starts) == len(symbols):
        return None
    sizes = np.diff(np.append(starts, len(symbols)))
    joined = sizes > 1
    return starts, _renamed(symbols, joined, (symbols[starts[joined]], sizes[joined]), starts)


def _pairs(symbols: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, names) with each left symbol before a right one joined to it. The sides are drawn anew each turn."""
    side = (mix(symbols.astype(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(1)).astype(bool)
    word = symbols >= 0  # ends of texts are below 0 and stay alone
    fits = word[:-1] & word[1:] & ~side[:-1] & side[1:]
    if np.count_nonzero(fits) < np.count_nonzero(word[:-1] & word[1:] & side[:-1] & ~side[1:]):
        fits = word[:-1] & word[1:] & side[:-1] & ~side[1:]
    change = np.ones(len(symbols), bool)
    change[1:] = ~fits
    starts = np.flatnonzero(change)
    joined = np.zeros(len(symbols), bool)
    joined[:-1] = fits
    at = starts[joined[starts]]
    return starts, _renamed(symbols, joined[starts], (symbols[at], symbols[at + 1]), starts)


def grammar(words: np.ndarray) -> list[Level]:
    """Levels over a sequence of word numbers, in which a number below 0 of its own stands before and after each text."""
    out = [Level(words, None, None)]
    marks = int((words < 0).sum())
    turn = 0
    while len(out[-1].symbol) > 2 * marks - 1:
        below = out[-1]
        made = _blocks(below.symbol)
        if made is None:
            turn += 1
            made = _pairs(below.symbol, turn)
            if len(made[0]) == len(below.symbol):
                continue
        starts, names = made
        first = np.append(starts, len(below.symbol))
        out[-1] = below._replace(parent=np.repeat(np.arange(len(starts)), np.diff(first)))
        out.append(Level(names, first, None))
    return out


def mirrored(levels: list[Level]) -> list[Level]:
    """The grammar of the sequence read backwards."""
    out = []
    for k, level in enumerate(levels):
        first = None if level.first is None else level.first[-1] - level.first[::-1]
        parent = None if level.parent is None else len(levels[k + 1].symbol) - 1 - level.parent[::-1]
        out.append(Level(level.symbol[::-1], first, parent))
    return out


def common_extension(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from each place a on equal those from the place b on. The places of a pair differ."""
    left, right = a.copy(), b.copy()
    stopped = np.zeros(len(a), np.int64)  # the level on which the two sides differ
    live = np.arange(len(a))
    for k in range(len(levels) - 1):
        level, above = levels[k], levels[k + 1]
        x, y = left[live], right[live]
        up_x, up_y = level.parent[x], level.parent[y]
        inside = (above.first[up_x] != x) | (above.first[up_y] != y)
        differ = inside & (level.symbol[x] != level.symbol[y])
        rest_x, rest_y = above.first[up_x + 1] - x, above.first[up_y + 1] - y
        step = np.where(inside & ~differ, np.minimum(rest_x, rest_y), 0)
        x, y = x + step, y + step
        # where one of two blocks of a symbol is longer, what follows the shorter one differs
        differ |= inside & (rest_x != rest_y)
        ends = live[differ]
        left[ends], right[ends], stopped[ends] = x[differ], y[differ], k
        live, x, y = live[~differ], x[~differ], y[~differ]
        left[live], right[live] = level.parent[x], level.parent[y]
        stopped[live] = k + 1
    for k in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero(stopped == k)
        level, below = levels[k], levels[k - 1]
        x, y = level.first[left[down]], level.first[right[down]]
        equal = below.symbol[x] == below.symbol[y]
        # two differing symbols that begin alike share the shorter block, or the first of two pairs
        size_x, size_y = level.first[left[down] + 1] - x, level.first[right[down] + 1] - y
        step = np.where(equal, np.where(size_x == size_y, 1, np.minimum(size_x, size_y)), 0)
        left[down], right[down], stopped[down] = x + step, y + step, k - 1
    return left - a


# --- runs


def candidates(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) such that every run holds a place from which its period leads to an equal word.

    words: texts one after another, longest first, with a number of its own before and after each; sizes: their words.
    """
    places, periods = [], []
    reach = np.cumsum(sizes + 1) + 1
    for q in range(1, int(sizes.max(initial=0)) // LEAST_EXPONENT + 1):
        grid = words[: reach[np.searchsorted(-sizes, -LEAST_EXPONENT * q, "right") - 1] : q]
        same = grid[1:] == grid[:-1]
        # a run holds three neighbouring equalities, so every third of a streak will do
        hit = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        if len(hit):
            gap = np.ones(len(hit), bool)
            gap[1:] = hit[1:] != hit[:-1] + 1
            streak = np.flatnonzero(gap)
            nth = np.arange(len(hit)) - np.repeat(streak, np.diff(np.append(streak, len(hit))))
            hit = hit[nth % 3 == 0]
            places.append((hit + 2) * q)
            periods.append(np.full(len(hit), q))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


class Runs(NamedTuple):
    """By text, then start, then period."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def runs_of(words: np.ndarray, first: np.ndarray) -> Runs:
    """All runs of texts; words[first[i]:first[i + 1]] are the numbers of text i."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= LEAST_WORDS]
    line, begin = _closed(words, first, order)
    place, period = candidates(line, sizes[order])
    text = np.searchsorted(begin, place, "right") - 1
    within = text == np.searchsorted(begin, place + period, "right") - 1
    place, period, text = place[within], period[within], text[within]
    with_hits = np.unique(text)
    if not len(with_hits):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none)
    # the grammar covers the texts with candidates only
    inner = place - begin[text]
    line, begin = _closed(words, first, order[with_hits])
    place = begin[np.searchsorted(with_hits, text)] + inner
    ahead = grammar(line)
    behind = mirrored(ahead)
    found = []
    for k in range(0, len(place), QUERIES):
        x, q = place[k : k + QUERIES], period[k : k + QUERIES]
        before = common_extension(behind, len(line) - x - q, len(line) - x)
        length = q + before + common_extension(ahead, x, x + q)
        good = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * q)
        found.append(np.stack([x - before, length, q], 1)[good])
    rows = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    smallest = np.ones(len(rows), bool)
    smallest[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    start, length, period = rows[smallest].T
    at = np.searchsorted(begin, start, "right") - 1
    text, start = order[with_hits][at], start - begin[at]
    by = np.lexsort((period, start, text))
    return Runs(text[by], start[by], length[by], period[by])


def _closed(words: np.ndarray, first: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given texts one after another, a number below 0 of its own before and after each, and where each begins."""
    sizes = np.diff(first)[texts]
    begin = np.cumsum(sizes + 1) - sizes
    line = np.empty(int((sizes + 1).sum()) + 1, np.int64)
    row, nth = spread(sizes)
    line[begin[row] + nth] = words[first[texts][row] + nth]
    line[np.append(0, begin + sizes)] = -1 - np.arange(len(texts) + 1)
    return line, begin


def dropped(runs: Runs, first: np.ndarray) -> np.ndarray:
    """By word: some run contains it after that run's first period."""
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    begin = first[runs.text] + runs.start
    np.add.at(edge, begin + runs.period, 1)
    np.add.at(edge, begin + runs.length, -1)
    return np.cumsum(edge)[:-1] > 0


# --- texts


def numbered(texts: Texts, words: Words) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    sizes = words.end - words.start
    row, nth = spread(sizes)
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    data = np.ascontiguousarray(texts.data[words.start[row] + nth])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def planted(first: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which word each word becomes. Texts with a seed (not below 0, a tenth of a checksum) are made periodic from one place on."""
    source = np.arange(int(first[-1]))
    sizes = np.diff(first)
    for text in np.flatnonzero((seeds >= 0) & (sizes > 0)):
        n, g = int(sizes[text]), int(seeds[text])
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[first[text] + a : first[text + 1]] = first[text] + a + np.arange(n - a) % p
    return source


def _joined(texts: Texts, start: np.ndarray, end: np.ndarray, counts: np.ndarray) -> list[str]:
    """The next ``counts[i]`` spans, joined by spaces, as text i."""
    sizes = end - start + 1
    row, nth = spread(sizes)
    at = np.minimum(start[row] + nth, max(len(texts.data) - 1, 0))
    data = texts.data[at]
    stops = np.cumsum(sizes)
    data[stops - 1] = 0x20
    bounds = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])]
    whole = data.tobytes()
    return [whole[a : max(a, b - 1)].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _find(size: int):
    def run(batches):
        for part, texts in slices(batches, size=size):
            words = words_of(texts, NOT_SPACE)
            seeds = np.asarray(part.column("seed").to_numpy(zero_copy_only=False), np.int64)
            source = planted(words.first, seeds)
            start, end = words.start[source], words.end[source]
            runs = runs_of(numbered(texts, words)[source], words.first)
            kept = ~dropped(runs, words.first)
            n_words = np.diff(words.first)
            left = np.bincount(words.text[kept], minlength=len(texts))
            counts = np.bincount(runs.text, minlength=len(texts))
            columns = [
                part.column("doc_id"),
                pa.array(n_words),
                *(ragged(x, counts, pa.int64()) for x in (runs.start, runs.length, runs.period)),
                pa.array(_joined(texts, start[kept], end[kept], left), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def find_runs(docs: DataFrame, seed: Column | None = None, size: int = SLICE) -> DataFrame:
    """(doc_id, n_words, run_start, run_length, run_period, collapsed) of docs(doc_id, text).

    The arrays hold all runs by start, then period; collapsed is the text's words, joined by spaces, with
    one period left of each run. With ``seed`` (a bigint column, null or below 0 for none) texts are first made periodic
    from word ``seed % n`` on: a test pattern.
    """
    chosen = F.coalesce(F.lit(None).cast("bigint") if seed is None else seed, F.lit(-1).cast("bigint"))
    return in_arrow(docs.select("doc_id", "text", chosen.alias("seed")), _find(size), SCHEMA)


def test_pattern(doc_id: str) -> Column:
    """The seed of every tenth document by checksum."""
    check = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.when(check % 10 == 0, F.floor(check / 10).cast("bigint"))


def digest(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the longest one, and checksums of all runs and of the collapsed text."""
    every = F.arrays_zip(F.col("run_start").alias("start"), F.col("run_length").alias("length"), F.col("run_period").alias("period"))
    best = F.array_min(F.transform(every, lambda r: F.struct((-r["length"]).alias("rank"), r["start"].alias("start"), r["period"].alias("period"))))
    told = F.transform(every, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("run_start").cast("bigint").alias("n_runs"),
        "best.start",
        (-F.col("best.rank")).alias("length"),
        "best.period",
        F.expr("(-best.rank * 1000) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
