"""Periodic runs against brute force over all stretches."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sendero.llm import periodic_runs as pr
from sendero.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period) of every run, by comparing each word with the one a period later."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - i >= max(6, 4 * q):
                found.setdefault((i, end + q - i), q)
            i = end + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = brute(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    start, length, period = best or (None, None, None)
    milli = best and 1000 * length // period
    return (doc_id, len(runs), start, length, period, milli, sha(told), sha(kept))


def texts():
    rng = random.Random(8)
    out = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "x " * 40, "a b " * 3, "a b " * 4, "b a b a b a b a c", "é è " * 9 + "\x0b\x0bü"]
    for _ in range(60):
        size = rng.choice([2, 2, 3, 30])
        out.append(" ".join(f"w{rng.randrange(size)}" for _ in range(rng.randrange(4, 90))))
    for _ in range(40):
        root = [f"v{rng.randrange(rng.choice([2, 9]))}" for _ in range(rng.randrange(1, 12))]
        body = root * rng.randrange(3, 9) + root[: rng.randrange(len(root))]
        ends = [[f"v{rng.randrange(9)}" for _ in range(rng.randrange(6))] for _ in range(2)]
        out.append(" \t".join(ends[0] + body + ends[1] + body))
    return out


def test_common_extensions_are_those_of_a_scan():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 50):
        for _ in range(20):
            parts = [rng.integers(0, size, rng.integers(6, 40)) for _ in range(3)]
            parts.append(np.tile(parts[0], 3))
            words = np.concatenate(parts)
            first = np.cumsum([0] + [len(p) for p in parts])
            line, begin = pr._closed(words, first, np.arange(4))
            levels = pr.grammar(line)
            assert len(levels[-1].symbol) == 9
            a = rng.integers(1, len(line) - 1, 60)
            b = rng.integers(1, len(line) - 1, 60)
            text = np.searchsorted(begin, a, "right")
            fits = (a != b) & (text == np.searchsorted(begin, b, "right"))
            a, b = a[fits], b[fits]
            for view, x, y in ((line, a, b), (line[::-1], len(line) - 1 - a, len(line) - 1 - b)):
                got = pr.common_extension(levels if view is line else pr.mirrored(levels), x, y)
                for i, j, n in zip(x, y, got, strict=True):
                    k = 0
                    while max(i, j) + k < len(view) and view[i + k] == view[j + k]:
                        k += 1
                    assert n == k


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_runs_are_those_of_brute_force(spark, size):
    rows = [(k, t, None) for k, t in enumerate(texts())] + [(None, "a b " * 5, None), (3, "one", None), (3, "one", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, seed string").repartition(3)
    got = pr.digest(pr.find_runs(docs, pr.test_pattern("doc_id"), size)).collect()
    want = [expected(k, t) for k, t, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 50
    plain = {r["doc_id"]: r["run_start"] for r in pr.find_runs(docs.filter("doc_id IS NOT NULL")).collect()}
    assert plain == {k: [s for s, _, _ in brute(WORD.findall(t or ""))] for k, t, _ in rows if k is not None}
    assert pr.digest(pr.find_runs(docs.limit(0))).collect() == []


def test_runs_of_many_short_texts_at_once():
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 60, 400)
    first = np.concatenate([[0], np.cumsum(sizes)])
    words = rng.integers(0, 2, first[-1]) * rng.integers(1, 40, 400).repeat(sizes)
    got = pr.runs_of(words, first)
    want = [(t, *r) for t in range(400) for r in brute(list(words[first[t] : first[t + 1]]))]
    assert [tuple(map(int, r)) for r in zip(*got, strict=True)] == want


def test_a_long_text_of_one_word():
    words, first = np.zeros(20000, np.int64), np.array([0, 20000])
    assert [tuple(map(int, r)) for r in zip(*pr.runs_of(words, first), strict=True)] == [(0, 0, 20000, 1)]


def test_query_is_that_of_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_periodic_runs"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(expected(r["doc_id"], r["text"]) for r in docs)
