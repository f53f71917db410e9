"""Token counts by overlap resynchronisation.

Short texts are encoded whole, in batches. A huge text is cut into chunks that overlap; chunks are rows, so
one document is encoded by many tasks. Of each chunk the counts before the word boundaries in its two
overlaps are kept. Two neighbouring chunks are spliced at the last boundary that both have:

* The splitting into words scans from left to right without looking back. So once a chunk has a true
  boundary, all its later boundaries are true, but for those so close to its end that what follows could
  change them (``margin`` characters: a special token, or a match and what it looks ahead at).
* The first chunk begins at a true boundary. A boundary that it shares with the next one is therefore true
  for both, and by induction every splice is. Merges never cross words, so tokens are those of the whole text.

The count of a text is the last chunk's, plus for each splice the tokens before it in the left chunk less
those before it in the right one: a plain sum. Where two chunks have no common boundary (a word longer than
the overlap), the texts concerned are cut again with wider overlaps, up to the whole text in one chunk.

Tokenizers whose words depend on more than what is to the right (normalisers, split rules other than the
byte-level one, special tokens that take blanks around them) are not cut: their texts are encoded whole.

Nulls count as empty; a null doc_id is carried. Repeated rows get equal counts: equal huge texts are encoded once.
Other columns are dropped. An empty table gives an empty table. Memory follows a batch or a chunk, and the
longest text where it is cut.
"""

from __future__ import annotations

import json
import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut
from .texts import in_arrow

MODEL = "byte_bpe_50k.json"
CHUNK = 1 << 15  # characters
OVERLAP = 1 << 10
LOOK_AHEAD = 8  # characters after a word that can change where it ends; 3 at most in the byte-level rule
PARTS_PER_BATCH = 16

COUNTED = "doc_id bigint, n_bytes bigint, key string, n_tokens bigint"
PARTS = "key string, part bigint, last boolean, begin bigint, piece string"
CODED = (
    "key string, part bigint, last boolean, n_tokens bigint, head_at array<bigint>, head_n array<bigint>, "
    "tail_at array<bigint>, tail_n array<bigint>"
)


class Vocabulary(NamedTuple):
    """A tokenizer file's text, and the margin at a chunk's end; null where texts cannot be cut."""

    rules: str
    margin: int | None


def load(path: str | None = None) -> Vocabulary:
    """Reads a tokenizer file; by default the byte-level one of the public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, encoding="utf-8") as file:
        rules = file.read()
    parsed = json.loads(rules)
    words, added = parsed.get("pre_tokenizer") or {}, parsed.get("added_tokens") or []
    byte_level = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space", True)
    plain = not any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip"))
    splits = byte_level and plain and not parsed.get("normalizer")
    margin = LOOK_AHEAD + max((len(t["content"]) for t in added), default=0) if splits else None
    return Vocabulary(rules, margin)


_loaded: dict[str, object] = {}


def tokenizer(rules: str):
    """The tokenizer of a task's process, with offsets that include blanks, and without a thread pool of its own."""
    if rules not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        made = Tokenizer.from_str(rules)
        made.no_truncation()
        made.no_padding()
        made.post_processor = processors.ByteLevel(trim_offsets=False)
        _loaded.clear()
        _loaded[rules] = made
    return _loaded[rules]


def _count_whole(rules):
    def run(batches):
        coder = tokenizer(rules.value)
        for batch in batches:
            huge = batch.column("key").is_valid()
            texts = batch.column("text").filter(pa.compute.invert(huge)).fill_null("").to_pylist()
            counts = np.zeros(batch.num_rows, np.int64)
            whole = ~huge.to_numpy(zero_copy_only=False)
            counts[whole] = [len(e) for e in coder.encode_batch_fast(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), batch.column("key"), pa.array(counts, mask=~whole)],
                ["doc_id", "n_bytes", "key", "n_tokens"],
            )

    return run


def _cut_up(chunk: int, overlap: int):
    names = [x.split()[0] for x in PARTS.split(", ")]

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n = max(1, -(-(len(text) - overlap) // chunk))
                rows = []
                for k in range(n):
                    end = len(text) if k == n - 1 else (k + 1) * chunk + overlap
                    rows.append((key, k, k == n - 1, k * chunk, text[k * chunk : end]))
                    if len(rows) == PARTS_PER_BATCH or k == n - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                        rows = []

    return run


def boundaries(coder, piece: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(tokens, places, counts): where words begin in a piece and how many tokens come before them."""
    coded = coder.encode(piece, add_special_tokens=False)
    word = np.array(coded.word_ids, np.int64)
    first = np.ones(len(word), bool)
    first[1:] = word[1:] != word[:-1]
    counts = np.flatnonzero(first)
    offsets = coded.offsets
    return len(word), np.array([offsets[t][0] for t in counts], np.int64), counts


def _encode(rules, chunk: int, overlap: int, margin: int):
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 4]
    names = [x.split()[0] for x in CODED.split(", ")]

    def run(batches):
        coder = tokenizer(rules.value)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                piece = row["piece"]
                n, at, before = boundaries(coder, piece)
                head = at < overlap
                tail = (at >= chunk) & (at <= len(piece) - margin) & (not row["last"])
                lists = [(x[side] + add).tolist() for side in (head, tail) for x, add in ((at, row["begin"]), (before, 0))]
                rows.append((row["key"], row["part"], row["last"], n, *lists))
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _spliced(coded: DataFrame) -> DataFrame:
    """(key, n_tokens): counts of whole texts; null where two chunks have no common boundary."""
    left = coded.filter("NOT last").select("key", "part", "tail_at", "tail_n")
    right = coded.select("key", (F.col("part") - 1).alias("part"), "head_at", "head_n")
    at = F.array_max(F.array_intersect("tail_at", "head_at"))
    count = lambda places, counts: F.get(counts, (F.array_position(places, F.col("at")) - 1).cast("int"))
    splices = left.join(right, ["key", "part"]).withColumn("at", at)
    gains = splices.select("key", (count("tail_at", F.col("tail_n")) - count("head_at", F.col("head_n"))).alias("n"))
    ends = coded.filter("last").select("key", F.col("n_tokens").alias("n"))
    every = gains.unionByName(ends).groupBy("key").agg(F.sum("n").alias("n"), F.bool_or(F.col("n").isNull()).alias("open"))
    return every.select("key", F.when(~F.col("open"), F.col("n")).alias("n_tokens"))


def count(docs: DataFrame, vocabulary: Vocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of docs(doc_id, text)."""
    spark = docs.sparkSession
    rules = spark.sparkContext.broadcast(vocabulary.rules)  # one vocabulary file
    text = F.coalesce("text", F.lit(""))
    huge = F.lit(False) if vocabulary.margin is None else F.char_length(text) > chunk + overlap
    keyed = docs.select(
        "doc_id",
        "text",
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.when(huge, F.sha2(text.cast("binary"), 256)).alias("key"),
    )
    counted = cut(in_arrow(keyed, _count_whole(rules), COUNTED), "counted")
    whole = counted.filter("key IS NULL").select("doc_id", "n_bytes", "n_tokens")
    left = counted.filter("key IS NOT NULL").select("doc_id", "n_bytes", "key")
    if vocabulary.margin is None or left.isEmpty():
        return whole
    rest = keyed.filter(huge).select("key", "text")
    done = None
    while True:
        parts = in_arrow(rest, _cut_up(chunk, overlap), PARTS)
        once = parts.groupBy("key", "part").agg(*[F.first(c).alias(c) for c in ("last", "begin", "piece")])
        coded = cut(in_arrow(once, _encode(rules, chunk, overlap, vocabulary.margin), CODED), "coded")
        found = cut(_spliced(coded), "spliced")
        closed, still = found.filter("n_tokens IS NOT NULL"), found.filter("n_tokens IS NULL").select("key")
        done = closed if done is None else done.unionByName(closed)
        if still.isEmpty():
            break
        rest = keyed.filter(huge).select("key", "text").join(still, "key", "left_semi")
        chunk = 4 * chunk
        overlap = min(16 * overlap, chunk)
    return whole.unionByName(left.join(done, "key").select("doc_id", "n_bytes", "n_tokens"))
