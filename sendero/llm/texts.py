"""Whole texts as byte arrays inside Arrow tasks: bounded slices, word spans, word hashes.

Everything works on UTF-8 bytes: the word classes used here contain every byte of a non-ASCII
character or none, so byte spans are character spans. Memory follows the slice (``SLICE_BYTES``, or
one text where that is longer), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 19
BATCH_BYTES = 4 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.Generator(np.random.PCG64(20240517)).integers(0, 1 << 63, 256, dtype=U64)
_POWERS = [np.ones(1, U64), np.ones(1, U64)]

_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
LOWER = _low

NOT_SPACE = np.ones(256, bool)  # [^\x20\x09-\x0D]
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lowering
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes, so that long texts do not pile up in one."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


class Texts(NamedTuple):
    """Texts laid end to end: text i is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    """Word spans in text order: start and end byte, and the text each word is in."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # first[i]: index of the first word of text i; one more entry at the end


def texts_of(column: pa.Array) -> Texts:
    """The bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if len(column) == 0 or data is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    offsets = np.frombuffer(at, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return Texts(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Parts of the batches with at most ``size`` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets = texts_of(batch.column(column)).offsets
        row = 0
        while row < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
            stop = min(max(stop, row + 1), batch.num_rows)
            part = batch.slice(row, stop - row)
            yield part, texts_of(part.column(column))
            row = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n."""
    if len(_POWERS[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=U64)
    return _POWERS[0], _POWERS[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hashes`` gets the hash of any span."""
    up, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def words_of(texts: Texts, is_word: np.ndarray) -> Words:
    """Maximal runs of the bytes that ``is_word`` marks; none reaches over the end of its text."""
    inside = np.zeros(len(texts.data) + 2, bool)
    inside[1:-1] = is_word[texts.data]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = texts.offsets[(texts.offsets > 0) & (texts.offsets < len(texts.data))]
    starts[edge] |= inside[1:-1][edge]
    ends[edge - 1] |= inside[1:-1][edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, texts.offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(start, end, text, first)


def window_hashes(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of ``width`` words that lies within one text."""
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(words.text[: len(hashes) - width + 1] == words.text[width - 1 :])
    out = np.zeros(len(at), U64)
    for k in range(width):
        out = out * U64(0xD1342543DE82EF95) + hashes[at + k]
    return at, mix(out + U64(width))


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: the next ``counts[i]`` values belong to row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged rows: the row of each element and its place within the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - begin[row]
