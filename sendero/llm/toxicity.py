"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Grams are hashed runs of 4, 6 and 8 bytes of the text, ASCII letters lower-cased; a gram counts by
log(1 + its count in the text). A sample of at most ``sample_rows`` labelled texts (those with the
smallest hash of their id) gives each gram's log-count ratio between toxic and other texts; the
``n_features`` grams with the most certain ratios carry a logistic regression on (gram) x (ratio).
Scoring looks at every gram of the whole text. The sample's ids are the only broadcast of the
training, and ``sample_rows`` bounds them; the driver fits on the sample's n_features grams.

Nulls: a null text scores like an empty one; labels with a null id or null mark teach nothing; texts
without any known gram get the intercept's score. Repeated rows are scored each, repeated labels of an
id count once, toxic if one says so. Labels of one class only give a constant score.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import cut
from .texts import LOWER, Texts, in_arrow, ragged, slices

SIZES = (4, 6, 8)
BUCKETS = 1 << 20
SAMPLE_ROWS = 10_000
N_FEATURES = 1 << 11
STEPS = 300
PENALTY = 3e-4


class Model(NamedTuple):
    """Weight by hashed gram; grams outside ``n_features`` weigh 0."""

    weight: np.ndarray
    intercept: float


def held_out(doc_id: str = "doc_id"):
    """Ids whose checksum is a multiple of 5 are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sample_labels(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic): at most ``rows`` ids outside the held-out fold, by the hash of their id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    one = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def grams(texts: Texts):
    """(bucket, text it begins in, text it ends in) of every run of bytes, one gram size after the other."""
    low = LOWER[texts.data].astype(np.uint32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(texts.offsets))
    for size in SIZES:
        n = len(low) - size + 1
        if n < 1:
            continue
        key = np.full(n, size, np.uint32)
        for k in range(size):
            key = key * np.uint32(0x01000193) + low[k : k + n]
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
        yield (key >> np.uint32(12)).view(np.int32), text[:n], text[size - 1 :]


def counted(texts: Texts, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, log-count) of the buckets that ``wanted`` marks, in order."""
    found = [np.zeros(0, np.int64)]
    for bucket, begins, ends in grams(texts):
        keep = np.flatnonzero(wanted[bucket])
        keep = keep[begins[keep] == ends[keep]]
        found.append(begins[keep].astype(np.int64) << 20 | bucket[keep])
    pairs, n = np.unique(np.concatenate(found), return_counts=True)
    return pairs >> 20, pairs & (BUCKETS - 1), np.log1p(n)


def _totals(batches):
    """Arrow function: the log-counts of this task's texts, summed by gram and mark."""
    sums, every = np.zeros((2, BUCKETS)), np.ones(BUCKETS, bool)
    for part, texts in slices(batches):
        mark = part.column("toxic").to_numpy()
        row, bucket, value = counted(texts, every)
        for k in (0, 1):
            of = mark[row] == k
            sums[k] += np.bincount(bucket[of], value[of], minlength=BUCKETS)
    for begin in range(0, BUCKETS, 1 << 16):
        gram = begin + np.flatnonzero(sums[:, begin : begin + (1 << 16)].any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram.astype(np.int32)), pa.array(sums[0][gram]), pa.array(sums[1][gram])], ["gram", "s0", "s1"]
        )


def _features(wanted: np.ndarray):
    """Arrow function: texts to their wanted grams and log-counts."""

    def run(batches):
        for part, texts in slices(batches):
            row, bucket, value = counted(texts, wanted)
            n = np.bincount(row, minlength=len(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), ragged(bucket.astype(np.int32), n, pa.int32()), ragged(value, n, pa.float64())],
                ["toxic", "grams", "counts"],
            )

    return run


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = N_FEATURES
) -> Model:
    """Learns from ``labels(doc_id, toxic)``; the driver gets n_features ratios and the sample's grams."""
    sample = sample_labels(labels, sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")
    texts = cut(texts, "toxicity")
    seen = in_arrow(texts, _totals, "gram int, s0 double, s1 double").groupBy("gram")
    seen = cut(seen.agg((F.sum("s0") + 1).alias("s0"), (F.sum("s1") + 1).alias("s1")), "toxicity")
    total = seen.agg(F.sum("s0").alias("t0"), F.sum("s1").alias("t1"))
    ratio = F.log(F.col("s1") / F.col("t1")) - F.log(F.col("s0") / F.col("t0"))
    certain = F.abs(ratio) / F.sqrt(1 / F.col("s1") + 1 / F.col("s0"))
    best = seen.join(F.broadcast(total)).select("gram", ratio.alias("r"), certain.alias("z"))
    best = best.orderBy(F.desc("z"), "gram").limit(n_features).collect()
    ratios = np.zeros(BUCKETS)
    ratios[[b["gram"] for b in best]] = [b["r"] for b in best]
    kept = in_arrow(texts, _features(ratios != 0), "toxic int, grams array<int>, counts array<double>").toArrow()
    return _logistic(kept.combine_chunks(), ratios)


def _logistic(rows: pa.Table, ratios: np.ndarray) -> Model:
    """Full-batch logistic regression, steps sized by Adam, on the ratio-scaled grams of the rows."""
    y = rows["toxic"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 5.0 if y.sum() else -5.0)
    n = np.array([len(x) for x in rows["grams"]])
    row = np.repeat(np.arange(len(y)), n)
    gram = rows["grams"].combine_chunks().flatten().to_numpy()
    value = rows["counts"].combine_chunks().flatten().to_numpy() * ratios[gram]
    spread_by = np.sqrt(np.mean(value**2)) if len(value) else 1.0
    used, place = np.unique(gram, return_inverse=True)
    value = value / spread_by
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(row, w[place] * value, minlength=len(y))
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        slope = np.append(np.bincount(place, off[row] * value, minlength=len(used)) + PENALTY * w, off.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weight = np.zeros(BUCKETS)
    weight[used] = w / spread_by * ratios[used]
    return Model(weight.astype(np.float32), float(b))


def _scores(weight: np.ndarray, intercept: float):
    """Arrow function: adds the score to each row."""

    def run(batches):
        wanted = weight != 0
        for part, texts in slices(batches):
            row, bucket, value = counted(texts, wanted)
            z = intercept + np.bincount(row, weight[bucket] * value, minlength=len(texts))
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            kept = [part.column(c) for c in part.schema.names if c != "text"]
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], [*names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; the text itself is all that counts."""
    scored = in_arrow(docs.select("doc_id", "text"), _scores(*model), "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, in one pass."""
    inner = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    schema = T.StructType([inner.schema["row"], T.StructField("score", T.DoubleType())])
    return in_arrow(inner, _scores(*model), schema).filter("score < 0.5").select("row.*")
