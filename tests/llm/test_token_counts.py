"""Token counts against the library on whole texts."""

import random

import pytest
from tokenizers import Tokenizer

import public_tokenizers
from sendero.llm import token_counts as tc
from sendero.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(texts, path=PATH):
    coder = Tokenizer.from_file(path)
    return [len(coder.encode(t or "", add_special_tokens=False)) for t in texts]


def texts():
    rng = random.Random(6)
    marks = ["<|endoftext|>", "<|endof", "|>", "   ", "\n\n", "\t", "don't", "we'll", "I'm", "漢字かな", "é", "😀", "12345", "!!!", "word", " ", "  x", "'", "\xa0", "0"]
    out = [None, "", " ", "one", "<|endoftext|>", "a" * 5000, " " * 3000, "ab " * 900 + "x" * 2500 + " cd" * 700, "!" * 700 + "<|endoftext|>" * 90]
    out += ["".join(rng.choice(marks) for _ in range(rng.randrange(100, 1500))) for _ in range(30)]
    return out


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 24), (200, 40), (500, 500), (tc.CHUNK, tc.OVERLAP)])
def test_counts_are_those_of_whole_texts(spark, chunk, overlap):
    every = texts()
    rows = [(k, t, "x", 0) for k, t in enumerate(every)] + [(None, every[7], "y", 1), (7, every[7], "x", 2), (7, None, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, n_tokens int").repartition(3)
    got = tc.count(docs, tc.load(PATH), chunk, overlap)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    counts = dict(zip(every, expected(every), strict=True))
    want = [(k, len((t or "").encode()), counts[t]) for k, t, *_ in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_every_splice_is_a_boundary_of_the_whole_text():
    vocabulary = tc.load(PATH)
    coder = tc.tokenizer(vocabulary.rules)
    for text in texts()[9:]:
        _, places, counts = tc.boundaries(coder, text)
        true = dict(zip(places.tolist(), counts.tolist(), strict=True))
        for begin in range(0, len(text) - 120, 37):
            _, left, _ = tc.boundaries(coder, text[: begin + 60])
            _, right, _ = tc.boundaries(coder, text[begin:])
            common = set(left[left <= begin + 60 - vocabulary.margin].tolist()) & set((right + begin).tolist())
            assert common <= set(true)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert tc.count(docs, tc.load(PATH)).collect() == []


def test_other_tokenizers_encode_texts_whole(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    vocabulary = tc.load(path)
    assert vocabulary.margin is None
    every = texts()
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tc.count(docs, vocabulary, 64, 24).collect()}
    assert [got[k] for k in range(len(every))] == expected(every, path)


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    n = expected([r["text"] for r in docs])
    want = [(r["doc_id"], len((r["text"] or "").encode()), k, k > 512) for r, k in zip(docs, n, strict=True)]
    assert sorted(map(tuple, QUERIES["op13_token_counts"](spark, FOLDER).collect())) == sorted(want)
