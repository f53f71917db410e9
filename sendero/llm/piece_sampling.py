"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice.

The lattice of a text has an arc for every run of bytes that is a piece (the piece's space mark stands
for a space), and one for every single byte that is no piece, at a weight that only matters where no
piece fits. The
forward pass sums the weights of all segmentations up to each place; the backward pass draws the last
piece, then the one before, each with its share of that sum. So a segmentation is drawn with the
probability of its weight among all of them. Draws come from a hash of the row's key, the seed and the
place, hence the same row gives the same pieces on any cluster. The pieces' bytes, laid end to end,
are the text, so decoding is lossless for every text (a literal space mark is written in bytes).

The lattice falls apart wherever no piece holds the two neighbouring bytes, for instance before each
space. Equal parts share one forward pass. Memory follows a slice of texts or the longest text.

Nulls: a null text has null pieces and decodes to null; an empty one has none. A null key draws like
one fixed key. Repeated rows get equal pieces. Other columns are carried.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import U64, Texts, in_arrow, mix, prefix_hashes, ragged, slices, span_hashes, spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
BYTE_WEIGHT = -40.0
SLICE = 3 << 20


class Vocabulary(NamedTuple):
    """Pieces by the hash of their bytes, and bytes by id. Bounded by the model file."""

    keys: np.ndarray  # sorted hashes
    ids: np.ndarray  # ids in the order of keys
    weights: np.ndarray  # log weights in the order of keys
    sizes: np.ndarray  # the byte lengths that pieces have
    maybe: np.ndarray  # by the top 20 bits of a hash: some piece may have it
    joined: np.ndarray  # joined[a, b]: some piece holds byte a and then b
    byte_ids: np.ndarray  # id of each byte
    lone: np.ndarray  # lone[b]: byte b is no piece
    data: np.ndarray  # all pieces' bytes
    offsets: np.ndarray  # of each id in data


def load(model: str = MODEL, alpha: float = 1.0) -> Vocabulary:
    """Reads a SentencePiece model. BPE scores are ranks, so a piece of rank r weighs (r + 1) ** -alpha;
    other models' scores are log-probabilities, and weigh exp(alpha * score)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    scores = [sp.get_score(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    ranked = all(scores[i] == int(scores[i]) for i in plain)
    texts = [b""] * n
    byte_ids = np.zeros(256, np.int32)
    for i in range(n):
        if sp.is_byte(i):
            byte = int(sp.id_to_piece(i)[1:-1], 16)
            byte_ids[byte] = i
            texts[i] = bytes([byte])
    weights = {}
    joined = np.zeros((256, 256), bool)
    for i in plain:
        texts[i] = sp.id_to_piece(i).replace(SPACE_MARK, " ").encode()
        weights[i] = -alpha * np.log1p(max(-scores[i], 0.0)) if ranked else alpha * scores[i]
        row = np.frombuffer(texts[i], np.uint8)
        joined[row[:-1], row[1:]] = True
    used = [i for i in plain if texts[i]]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    at = np.array(used)
    keys = span_hashes(prefix_hashes(data), offsets[at], offsets[at + 1])
    order = np.argsort(keys)
    maybe = np.zeros(1 << 20, bool)
    maybe[(keys >> U64(44)).astype(np.int64)] = True
    sizes = np.unique(np.diff(offsets)[at])
    lone = np.ones(256, bool)
    lone[[texts[i][0] for i in used if len(texts[i]) == 1]] = False
    return Vocabulary(
        keys[order], at[order].astype(np.int32), np.array([weights[i] for i in at[order]]), sizes, maybe, joined,
        byte_ids, lone, data, offsets,
    )


class Lattice(NamedTuple):
    """Arcs sorted by the place they end at, longest first; places count the bytes of all parts."""

    begin: np.ndarray  # place where the arc begins
    piece: np.ndarray
    upto: np.ndarray  # share of the arcs up to this one among those with the same end
    first: np.ndarray  # by place: its first arc


def lattice(texts: Texts, vocabulary: Vocabulary) -> Lattice:
    """Forward pass over parts (as texts, none empty)."""
    data, n = texts.data, len(texts.data)
    sums = prefix_hashes(data)
    sizes = np.diff(texts.offsets)
    first = np.repeat(texts.offsets[:-1], sizes)
    stop = np.repeat(texts.offsets[1:], sizes)
    place = np.arange(n)
    lone = place[vocabulary.lone[data]]
    begins, ends, pieces = [lone], [lone + 1], [vocabulary.byte_ids[data[lone]]]
    weights = [np.full(len(lone), BYTE_WEIGHT)]
    for size in vocabulary.sizes.tolist():
        at = place[: max(n - size + 1, 0)]
        at = at[at + size <= stop[at]]
        key = span_hashes(sums, at, at + size)
        found = vocabulary.maybe[(key >> U64(44)).astype(np.int64)]
        at, key = at[found], key[found]
        where = np.minimum(np.searchsorted(vocabulary.keys, key), len(vocabulary.keys) - 1)
        found = vocabulary.keys[where] == key
        at, where = at[found], where[found]
        begins.append(at)
        ends.append(at + size)
        pieces.append(vocabulary.ids[where])
        weights.append(vocabulary.weights[where])
    begin, end, piece, weight = map(np.concatenate, (begins, ends, pieces, weights))
    # by how far into its part an arc ends, then by end: one step of the loop is one run of arcs
    depth = end - first[begin]
    order = np.argsort((depth << 40) + (end << 8) - np.minimum(end - begin, 255))
    begin, end, piece, weight, depth = begin[order], end[order], piece[order], weight[order], depth[order]
    cuts = np.searchsorted(depth, np.arange(1, (depth[-1] if n else 0) + 2))
    new = np.r_[True, end[1:] != end[:-1]] if n else np.zeros(0, bool)
    total = np.zeros(n + 1)  # log of the summed weights up to a place within a part
    share = np.ones(len(begin))
    inner = depth > end - begin  # arcs that begin within a part, not at its head
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        value = weight[lo:hi] + np.where(inner[lo:hi], total[begin[lo:hi]], 0.0)
        heads = np.flatnonzero(new[lo:hi])
        if not len(heads):
            continue
        counts = np.diff(heads, append=hi - lo)
        top = np.maximum.reduceat(value, heads)
        mass = np.exp(value - np.repeat(top, counts))
        run = np.cumsum(mass)
        whole = np.add.reduceat(mass, heads)
        share[lo:hi] = (run - np.repeat(run[heads] - mass[heads], counts)) / np.repeat(whole, counts)
        total[end[lo:hi][heads]] = top + np.log(whole)
    share[np.r_[new[1:], True] if n else new] = 1.0
    arc_of = np.zeros(n + 1, np.int64)
    arc_of[end[new]] = np.flatnonzero(new)
    return Lattice(begin, piece, share, arc_of)


def parts_of(texts: Texts, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each part, text of each part): cuts wherever no piece holds both neighbours."""
    data = texts.data
    cut = np.zeros(len(data), bool)
    cut[1:] = ~joined[data[:-1], data[1:]]
    inner = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    cut[inner] = True
    start = np.flatnonzero(cut)
    return start, np.searchsorted(texts.offsets, start, "right") - 1


def sample(texts: Texts, keys: np.ndarray, vocabulary: Vocabulary, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all texts in order, how many each text has)."""
    if not len(texts.data):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    start, text = parts_of(texts, vocabulary.joined)
    end = np.r_[start[1:], len(texts.data)]
    _, head, kind = np.unique(
        span_hashes(prefix_hashes(texts.data), start, end), return_index=True, return_inverse=True
    )
    sizes = (end - start)[head]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    row, within = spread(sizes)
    net = lattice(Texts(texts.data[start[head][row] + within], offsets), vocabulary)
    number = np.arange(len(start)) - np.searchsorted(text, text)  # of the part within its text
    draw = mix(mix(keys[text] + U64(seed)) + number.astype(U64))
    at, floor, live = offsets[kind + 1].copy(), offsets[kind], np.arange(len(start))
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        draw[live] = mix(draw[live] + U64(0x9E3779B97F4A7C15))
        u = (draw[live] >> U64(11)).astype(np.float64) * 2.0**-53
        arc = net.first[at[live]]
        more = np.flatnonzero(u >= net.upto[arc])
        while len(more):
            arc[more] += 1
            more = more[u[more] >= net.upto[arc[more]]]
        taken.append((live, net.piece[arc]))
        at[live] = net.begin[arc]
        live = live[at[live] > floor[live]]
    counts = np.zeros(len(start), np.int64)
    for which, _ in taken:
        counts[which] += 1
    last = np.cumsum(counts) - 1
    pieces = np.zeros(int(counts.sum()), np.int32)
    for step, (which, piece) in enumerate(taken):  # the first draw is a part's last piece
        pieces[last[which] - step] = piece
    return pieces, np.bincount(text, counts, minlength=len(texts)).astype(np.int64)


def _encode(vocabulary: Vocabulary, seed: int):
    def run(batches):
        for part, texts in slices(batches, size=SLICE):
            keys = mix(part.column("sample_key").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
            pieces, counts = sample(texts, keys, vocabulary, seed)
            column = ragged(pieces, counts, pa.int32())
            if part.column("text").null_count:
                column = pa.array(column.to_pylist(), column.type, mask=part.column("text").is_null().to_numpy(False))
            yield pa.RecordBatch.from_arrays([part.column("row"), column], ["row", "pieces"])

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """docs' columns plus pieces array<int>: one sampled segmentation of ``text`` per row."""
    rows = docs.select(
        F.struct("*").alias("row"), F.col("text").alias("text"), F.xxhash64(F.col(key).cast("string")).alias("sample_key")
    )
    schema = T.StructType([rows.schema["row"], T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != "pieces"]
    return in_arrow(rows, _encode(vocabulary, seed), schema).select(*kept, "pieces")


def _decode(vocabulary: Vocabulary):
    sizes = np.diff(vocabulary.offsets)

    def run(batches):
        for batch in batches:
            column = batch.column("pieces")
            ids = column.flatten().to_numpy()
            counts = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, within = spread(sizes[ids])
            data = vocabulary.data[vocabulary.offsets[ids][row] + within]
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])
            offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
            texts = pa.Array.from_buffers(
                pa.large_string(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes())]
            ).cast(pa.string())
            if column.null_count:
                texts = pa.compute.if_else(column.is_null(), pa.scalar(None, pa.string()), texts)
            yield pa.RecordBatch.from_arrays([batch.column("row"), texts], ["row", "decoded"])

    return run


def decode(pieces: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The rows plus decoded: the bytes of ``pieces array<int>``, laid end to end."""
    rows = pieces.select(F.struct("*").alias("row"), "pieces")
    schema = T.StructType([rows.schema["row"], T.StructField("decoded", T.StringType())])
    return in_arrow(rows, _decode(vocabulary), schema).select("row.*", "decoded")
