"""Quality rules by compression: zstandard ratios of whole texts and of fixed chunks.

A text's ratio is its compressed size over its size in bytes. Repetitive text compresses to little,
random text hardly at all; what is normal depends on the length, so each length band has its own
limits. Long texts are also compressed in chunks of ``CHUNK`` bytes, the last of which ends where the text
ends: they go if a third of their chunks or more, or ``BAD_RUN`` in a row, leave the chunk limits. A text of no more
than a chunk is its own only chunk. Base rules come first: too few words, too many repeated words.

Nulls and texts without words have no words and fail the base rules; empty texts have no chunk. Bytes of all
lengths are compressed; short texts have no upper limit, since headers outweigh content there. Repeated rows get
equal verdicts, an empty table gives an empty table, columns other than doc_id and text are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .texts import NOT_SPACE, Texts, Words, in_arrow, prefix_hashes, slices, span_hashes, window_hashes, words_of

LEVEL = 3
CHUNK = 4096
MIN_WORDS = 20
REPEAT_SHARE = (30, 100)
REPEAT_WINDOW = 8

# Lower and upper limit of the ratio by length in bytes: (shortest length, low, high)
BANDS = ((0, 0.0, 9.9), (64, 0.45, 9.9), (256, 0.40, 0.90), (1024, 0.30, 0.74), (4096, 0.28, 0.74), (32768, 0.25, 0.74))
CHUNK_BAND = (0.25, 0.74)
BAD_SHARE = (1, 3)
BAD_RUN = 4

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, n_chunks bigint, n_bad_chunks bigint"
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HEAD = np.ones(256, bool)  # bytes that begin a character
_HEAD[0x80:0xC0] = False


def band(size: int) -> tuple[float, float]:
    """The limits for a text of this many bytes."""
    return next((low, high) for least, low, high in reversed(BANDS) if size >= least)


def repeated_words(words: Words, hashes: np.ndarray, n_texts: int) -> np.ndarray:
    """Per text, the words in windows of 8 words that the text has twice or more."""
    at, window = window_hashes(words, hashes, REPEAT_WINDOW)
    if not len(at):
        return np.zeros(n_texts, np.int64)
    text = words.text[at]
    order = np.lexsort((window, text))
    same = (window[order][1:] == window[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + REPEAT_WINDOW, -1)
    return np.bincount(words.text[np.cumsum(edge)[:-1] > 0], minlength=n_texts)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def chunk_starts(begin: int, end: int) -> list[int]:
    """Where the chunks of a long text begin: one after another, and a last one that ends with the text."""
    starts = list(range(begin, end - CHUNK + 1, CHUNK))
    return starts if (end - begin) % CHUNK == 0 else [*starts, end - CHUNK]


def compressed(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the ratio, whether its band and its chunks allow it, its chunks, and those outside the chunk limits."""
    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    ratio, fits = np.ones(len(texts)), np.ones(len(texts), bool)
    chunks, bad = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    data = memoryview(np.ascontiguousarray(texts.data))
    for row in range(len(texts)):
        begin, end = int(texts.offsets[row]), int(texts.offsets[row + 1])
        if begin == end:
            continue
        ratio[row] = len(press.compress(data[begin:end])) / (end - begin)
        low, high = band(end - begin)
        fits[row] = low <= ratio[row] <= high
        if end - begin <= CHUNK:
            chunks[row], bad[row] = 1, not fits[row]
            continue
        run = longest = 0
        for at in chunk_starts(begin, end):
            part = len(press.compress(data[at : at + CHUNK])) / CHUNK
            off = not CHUNK_BAND[0] <= part <= CHUNK_BAND[1]
            run = run + 1 if off else 0
            longest = max(longest, run)
            chunks[row] += 1
            bad[row] += off
        fits[row] &= longest < BAD_RUN and (bad[row] == 0 or BAD_SHARE[1] * bad[row] < BAD_SHARE[0] * chunks[row])
    return ratio, fits, chunks, bad


def _judge(batches):
    for part, texts in slices(batches):
        n = len(texts)
        words = words_of(texts, NOT_SPACE)
        n_words = np.diff(words.first)
        hashes = span_hashes(prefix_hashes(texts.data), words.start, words.end)
        chars = _sums(NOT_SPACE[texts.data] & _HEAD[texts.data], texts.offsets)
        symbols = _sums(_SYMBOL[texts.data], texts.offsets)
        repeats = repeated_words(words, hashes, n)
        data = bytes(texts.data)
        lines = np.array([repeated_lines(data[a:b]) for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)])
        failed = (n_words < MIN_WORDS) | (REPEAT_SHARE[1] * repeats > REPEAT_SHARE[0] * n_words)
        ratio, fits, chunks, bad = compressed(texts)
        kept = ~failed & fits
        columns = [n_words, chars, symbols, lines, repeats, failed, kept, ratio, chunks, bad]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)], names)


def judge(docs: DataFrame) -> DataFrame:
    """Counts, compression ratios and the verdict of every document."""
    return in_arrow(docs.select("doc_id", "text"), _judge, SCHEMA)
