"""The manifest against a tree built recursively in plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sendero.llm import merkle_log as ml

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree string, at int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    told = [None if v is None else str(v) for v in row]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in told))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha("".join(last[k : k + 8])) for k in range(0, len(last), 8)])
    return out


def sides(tree, at):
    out = []
    for nodes in tree[:-1]:
        first = at // 8 * 8
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])))
        at //= 8
    return out


def expected(rows):
    """rows(doc_id, text, lang, source, n_chars) -> the manifest, with texts lower-cased where the id is even."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        changed = text if text is None or doc_id is None or doc_id % 2 else text.lower()
        one = leaf((doc_id, source, lang, n_chars, text)), leaf((doc_id, source, lang, n_chars, changed))
        groups.setdefault(lang, []).append((doc_id, *one))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {g: levels([r[1] for r in groups[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, (doc_id, before, after) in enumerate(groups[g]):
            way = sides(trees[g], at) + sides(top, k)
            folded = after
            for left, right in way:
                folded = sha(left + folded + right)
            out.append((doc_id, before, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), folded))
    return out


def made(spark, rows, levels=ml.TIER):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS).repartition(5)
    low = {"text": F.lower("text")}
    return ml.manifest(docs, FIELDS, "lang", changed=low, where=F.col("doc_id") % 2 == 0, levels=levels)


def rows_of(rng, n, langs):
    return [(k, rng.choice([None, "", "Abc", "é B c", "low"]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, k])) for k in range(n)]


@pytest.mark.parametrize(("n", "langs"), [(1, ["a"]), (65, ["a"]), (700, [None, "", "b", "B", "é"])])
def test_manifest_is_that_of_plain_trees(spark, n, langs):
    rows = rows_of(random.Random(n), n, langs)
    got = made(spark, rows, 1)  # every level a tier of its own
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(rows))


def test_many_groups_and_production_tiers(spark):
    rng = random.Random(1)
    rows = rows_of(rng, 5000, ["a"]) + [(k, "x", f"g{k}", None, None) for k in range(9000, 9075)]
    assert sorted(map(tuple, made(spark, rows).collect())) == sorted(expected(rows))


def test_null_and_repeated_ids(spark):
    rows = [(None, "A", "a", None, None), (None, "B", "a", None, None), (4, "Same", None, "s", 1)] + [(5, "Same", "a", "s", 1)] * 40
    got = sorted(map(tuple, made(spark, rows).collect()), key=repr)
    assert got == sorted(expected(rows), key=repr)
    by_id = {r[0]: r for r in got}
    assert by_id[4][5] != by_id[4][3] and by_id[5][5] == by_id[5][3]


def test_empty_table(spark):
    assert made(spark, []).collect() == []


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 511, 513, 4096, 5000])
def test_positions_are_those_of_a_postorder_walk(n):
    size, walk = ml.widths(n), []

    def visit(level, at):
        if level:
            for child in range(8 * at, min(8 * at + 8, size[level - 1])):
                visit(level - 1, child)
        walk.append((level, at))

    visit(len(size) - 1, 0)
    for level, width in enumerate(size):
        for at, place in enumerate(ml.position(n, level, np.arange(width))):
            assert walk[place] == (level, at)


def test_the_log_is_whole_and_in_order(spark):
    digests = [sha(str(k)) for k in range(5000)]
    leaves = spark.createDataFrame([("a", 5000, k, d) for k, d in enumerate(digests)], "tree string, n bigint, at bigint, digest string")
    log = {r["position"]: (r["level"], r["at"], r["digest"]) for r in ml.Forest(leaves).log().collect()}
    tree = levels(digests)
    assert sorted(log) == list(range(sum(map(len, tree))))
    assert all(tree[level][at] == digest for level, at, digest in log.values())
