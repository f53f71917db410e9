"""Each operator against a brute-force version, round trips, and the edge cases its docstring defines."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from sendero.llm import (
    compression,
    decontamination,
    jaccard_join,
    line_dedup,
    piece_sampling,
    pseudonyms,
    secrets,
    spans,
    toxicity,
    url_rules,
    warc,
)
from sendero.llm.texts import NOT_SPACE, U64, mix, texts_of, words_of
from sendero.plans.session import scratch

DOCS = "doc_id bigint, text string, row string, pieces string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts):
    """Documents with clashing extra columns; ids count from 0."""
    return spark.createDataFrame([(k, t, f"r{k}", None) for k, t in enumerate(texts)], DOCS)


def words(rng, n, size=200):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def near(rng, text, n):
    out = text.split(" ")
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


EDGES = [None, "", " \n\t ", "one", "One", "a b c", "é " * 30, "x" * 3000]


# --- words


@pytest.mark.parametrize("texts", [EDGES, [], [None], ["a", "b"], ["a ", " b", "", "c"]])
def test_words_are_those_of_a_regex(texts):
    column = texts_of(pa.array(texts, pa.string()))
    found = words_of(column, NOT_SPACE)
    got = [(int(t), bytes(column.data[a:b]).decode()) for a, b, t in zip(found.start, found.end, found.text, strict=True)]
    assert got == [(k, w) for k, t in enumerate(texts) for w in WORD.findall(t or "")]


# --- 1


def sets_of(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for text in texts:
        w = WORD.findall((text or "").translate(low))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def components(sets, percent=80):
    comp = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                old, new = comp[i], comp[j]
                comp = [min(old, new) if c in (old, new) else c for c in comp]
    return comp


def test_jaccard_components(spark, monkeypatch):
    rng = random.Random(3)
    base = [words(rng, rng.choice([4, 5, 30, 120, 400]), 3000) for _ in range(15)]
    texts = [*EDGES, *base, *base[:4]]
    texts += [near(rng, b, rng.choice([1, 2, 4])) for b in base for _ in range(4) if len(b.split()) > 20]
    chain = base[4]
    for _ in range(12):  # each text links with its neighbours only
        chain = near(rng, words(rng, 300, 9000) if len(chain.split()) < 100 else chain, 3)
        texts.append(chain)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "LEAF", 2)
    rows = {r["doc_id"]: r for r in jaccard_join.join(table(spark, texts)).collect()}
    sets = sets_of(texts)
    assert [rows[k]["n_shingles"] for k in range(len(texts))] == [len(s) for s in sets]
    assert [rows[k]["component_id"] for k in range(len(texts))] == components(sets)
    kept = jaccard_join.keep_first(table(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(components(sets)))
    assert kept.columns == ["doc_id", "text", "row", "pieces"]


def test_points_move_only_where_sizes_leave_a_link_open(spark, monkeypatch):
    rng = random.Random(4)
    head = words(rng, 9)
    texts = [" ".join([head, words(rng, n)]) for n in (6, 60, 61, 600)] + [words(rng, 50)] * 2
    moved, starred = [], []
    blocks, star = jaccard_join._in_blocks, jaccard_join.in_arrow
    monkeypatch.setattr(jaccard_join, "_in_blocks", lambda members: moved.append(members.columns) or blocks(members))

    def watched(df, run, schema):
        if "leader_point" in df.columns:
            starred.append(df.count())
        return star(df, run, schema)

    monkeypatch.setattr(jaccard_join, "in_arrow", watched)
    assert len({r["component_id"] for r in jaccard_join.join(table(spark, texts)).collect()}) == 5
    assert moved and not any("point" in columns for columns in moved)
    assert starred and max(starred) <= 1  # of four texts with a common beginning only two are near in size


def test_jaccard_null_and_repeated_ids(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (7, "other words are here now"), (None, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect()), key=repr)
    assert got == sorted([(None, 4, 7), (7, 4, 7), (7, 4, 7), (7, 1, 7), (None, 0, None)], key=repr)
    assert jaccard_join.join(docs.limit(0)).collect() == []


def test_tree_finds_every_pair_that_may_link():
    rng = np.random.default_rng(5)
    points = [rng.poisson(4, 16).astype(np.uint8) for _ in range(60)] + [rng.poisson(8, 32).astype(np.uint8) for _ in range(30)]
    points += [p.copy() for p in points[:20]]
    sizes = np.array([int(p.sum()) for p in points])
    comps = np.arange(len(points))
    found = {tuple(sorted((int(i), int(j)))) for a, b, _ in jaccard_join.open_pairs(points, sizes, comps, 80) for i, j in zip(a, b, strict=True)}
    want = {
        (i, j)
        for j in range(len(points))
        for i in range(j)
        if max(len(points[i]), len(points[j])) <= 2 * min(len(points[i]), len(points[j]))
        and jaccard_join.may_link(points[i], points[j], sizes[i], sizes[j], 80)
    }
    assert found == want


# --- 2


def brute_hits(text, items, window=13):
    w = decontamination.item_words(text)
    hit, names = set(), set()
    for name, item in items:
        v = decontamination.item_words(item)
        k = min(window, len(v))
        grams = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)} if v else set()
        for p in range(len(w) - k + 1 if k else 0):
            if tuple(w[p : p + k]) in grams:
                hit.update(range(p, p + k))
                names.add(name)
    return len(w), len(hit), names


@pytest.mark.parametrize("max_words", [10**6, 40])
def test_decontamination(spark, max_words):
    rng = random.Random(1)
    items = [(k, words(rng, rng.choice([1, 3, 12, 13, 14, 40]), 4)) for k in range(25)] + [(90, None), (91, "..."), (92, "A-b c")]
    texts = [*EDGES, "a B, c", *(words(rng, 60, 4) for _ in range(30)), words(rng, 200) + " " + items[5][1] + " tail"]
    table_of_items = spark.createDataFrame(items, "item_id bigint, text string")
    automata = decontamination.build(table_of_items, max_words=max_words)
    assert (len(automata) > 1) == (max_words == 40)
    got = {r["row"]["doc_id"]: r for r in decontamination.measured(table(spark, texts), automata).collect()}
    for k, text in enumerate(texts):
        n, hit, names = brute_hits(text, items)
        assert (got[k]["n_words"], got[k]["n_hit"], set(got[k]["items"])) == (n, hit, names)
    none = decontamination.build(table_of_items.limit(0))
    assert decontamination.measured(table(spark, texts), none).filter("n_hit > 0").count() == 0


def test_spans_are_cut_out(spark):
    item = " ".join(f"t{k}" for k in range(20))
    automata = decontamination.build(spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    docs = table(spark, [f"before; {item.upper()}! after", "nothing", None])
    assert [r["text"] for r in decontamination.cut_spans(docs, automata).orderBy("doc_id").collect()] == ["before; ! after", "nothing", None]


# --- 3


def test_toxicity_learns_and_ignores_the_held_out(spark):
    rng = random.Random(2)
    texts = [words(rng, 60, 80) + (" vile slur " * 3 if k % 4 == 0 else "") for k in range(400)]
    docs = table(spark, texts)
    labels = [(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (3, None)]
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    rows = toxicity.score(docs, model).collect()
    held = [r for r in rows if r["held_out"]]
    assert 40 < len(held) < 120
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    flipped = [(k, 1 - v if v is not None and k is not None and any(r["doc_id"] == k and r["held_out"] for r in rows) else v) for k, v in labels]
    again = toxicity.fit(docs, spark.createDataFrame(flipped, "doc_id bigint, toxic int"))
    assert np.array_equal(model.weight, again.weight)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if not r["predicted"]}


def test_toxicity_edges(spark):
    docs = table(spark, EDGES)
    one = toxicity.fit(docs, spark.createDataFrame([(k, 0) for k in range(8)], "doc_id bigint, toxic int"))
    assert all(r["score"] < 0.5 for r in toxicity.score(docs, one).collect())
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score(docs, none).count() == len(EDGES)


# --- 4


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    twice = {k + d for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for d in range(8)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(twice)


def test_compression_counts_and_ratios(spark):
    rng = random.Random(4)
    texts = [*EDGES, words(rng, 500), "same line\n\nsame line\n " * 30, "a b c d e f g h " * 3, "#*$%&|<> 🙂é"]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/ ") for _ in range(9000))]
    texts += [words(rng, 9000, 5000)]
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(n))
    prose = words(rng, 40000, 5000)
    texts += [prose[:4096] + noise(4095), prose[:4096] + noise(4096), prose[:90000] + noise(20000) + prose[90000:], prose[:4096], prose[:8191]]
    for row in compression.judge(table(spark, texts)).collect():
        text = texts[row["doc_id"]]
        want = brute_quality(text)
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        data = (text or "").encode()
        ratio = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(data)) / len(data) if data else 1.0
        assert math.isclose(row["ratio"], ratio)
        low, high = compression.band(len(data))
        assert row["n_chunks"] == -(-len(data) // compression.CHUNK)
        starts = [k * 4096 for k in range(len(data) // 4096)] + ([len(data) - 4096] if len(data) % 4096 else [])
        parts = [data[k : k + 4096] for k in starts] if len(data) > 4096 else []
        off = [not 0.25 <= len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(x)) / 4096 <= 0.74 for x in parts]
        rows_off = any(all(off[k : k + 4]) for k in range(len(off) - 3))
        chunks_fit = not rows_off and (not any(off) or 3 * sum(off) < len(off))
        if parts:
            assert row["n_bad_chunks"] == sum(off)
        assert row["kept"] == (not row["base_failed"] and low <= ratio <= high and chunks_fit)
    verdicts = {r["doc_id"]: r["kept"] for r in compression.judge(table(spark, texts)).collect()}
    at = len(texts) - 5
    assert not verdicts[at - 2] and verdicts[at - 1]
    assert [verdicts[at + k] for k in range(5)] == [False, False, False, True, True]


def test_compression_of_empty_tables_and_equal_rows(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30, "x")] * 2 + [(None, None, "y")], "doc_id bigint, text string, kept string")
    rows = compression.judge(docs).collect()
    assert len(rows) == 3 and len({tuple(r) for r in rows}) == 2
    assert compression.judge(docs.limit(0)).collect() == []


# --- 5


def test_line_dedup_removes_shared_passages_only(spark):
    rng = random.Random(6)
    line = lambda: " ".join(f"u{rng.randrange(10**7)}" for _ in range(14)) + "."
    passage = "\n".join(line() for _ in range(12))
    own = ["\n".join(line() for _ in range(9)) for _ in range(6)]
    texts = [own[0] + "\n" + passage + "\n" + own[1], own[2] + "\n" + passage + "\n" + own[3], own[4], own[5], own[5], None, "", "short\n"]
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert [rows[k]["text"] for k in (0, 2, 3, 5, 6, 7)] == [texts[k] for k in (0, 2, 3, 5, 6, 7)]
    assert rows[0]["row"] == "r0" and rows[0]["n_removed"] == 0
    assert not rows[4]["text"].strip() or len(rows[4]["text"]) < len(texts[4]) / 3
    left = rows[1]["text"]
    assert rows[1]["n_removed"] > 0 and len(left) < len(texts[1]) - len(passage) / 3
    assert all(x in left for x in (own[2] + "\n" + own[3]).split("\n"))


def test_chunks_laid_end_to_end_are_the_text(spark):
    rng = random.Random(8)
    texts = [x for x in EDGES if x] + ["".join(rng.choice("ab .!\n") for _ in range(300)) for _ in range(40)]
    docs = table(spark, texts)
    rows = docs.select("text", line_dedup.chunks(docs["text"]).alias("c")).collect()
    assert all("".join(x for chunk in r["c"] for x in chunk) == r["text"] for r in rows)


def brute_lines_lost(texts, long_words=50, least=10):
    """Per text, what the rule says must go: words (with their line) in a run that stands earlier."""
    blanks = " \t\n\x0b\x0c\r"
    seen, out = set(), []
    for text in texts:
        lines = re.split(r"(?<=\n)|(?<=[.!?] )", text)
        bare = [x.strip(blanks) for x in lines]
        n = [len(WORD.findall(x)) for x in bare]
        drop = [set() for _ in lines]
        for k in range(len(lines)):
            cases = [(bare[k], [(k, None)])] if n[k] >= least else []
            if k + 1 < len(lines) and bare[k] and bare[k + 1] and min(n[k], n[k + 1]) < least:
                cases.append((bare[k] + "\n" + bare[k + 1], [(k, None), (k + 1, None)]))
            if n[k] > long_words:
                w = WORD.findall(bare[k])
                cases += [(" ".join(w[i : i + least]), [(k, j) for j in range(i, i + least)]) for i in range(n[k] - least + 1)]
            for content, places in cases:
                if content in seen:
                    for line, word in places:
                        drop[line] |= set(range(n[line])) if word is None else {word}
                seen.add(content)
        out.append([w for k, x in enumerate(bare) for i, w in enumerate(WORD.findall(x)) if i not in drop[k]])
    return out


def test_line_dedup_finds_passages_of_50_to_100_words_in_any_context(spark):
    rng = random.Random(16)
    word = lambda: f"v{rng.randrange(10**8)}"
    sentences = lambda n, sizes: " ".join(" ".join(word() for _ in range(rng.choice(sizes))) + "." for _ in range(n))
    passages, texts = [], []
    for sizes in [(3, 7, 12, 20), (4, 5, 6), (13, 25), (30,)]:
        for _ in range(15):
            passage = ""
            while len(passage.split()) < 50:
                passage = (passage + " " + sentences(1, sizes)).strip()
            passages.append(passage)
    plain = [" ".join(word() for _ in range(rng.randrange(50, 101))) for _ in range(15)]
    for passage in passages:
        texts += [f"{sentences(3, (4, 15))} {passage} {sentences(3, (4, 15))}" for _ in range(2)]
    for passage in plain:  # in one line without marks
        around = lambda: " ".join(word() for _ in range(rng.randrange(20, 60)))
        texts += [f"{around()} {passage} {around()}" for _ in range(2)]
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert [rows[k]["text"] for k in range(0, len(texts), 2)] == texts[::2]
    for k, passage in enumerate(passages + plain):
        assert not set(passage.split()) & set(rows[2 * k + 1]["text"].split())
        assert rows[2 * k + 1]["text"].split() == [w for w in texts[2 * k + 1].split() if w not in set(passage.split())]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(26)
    pool = [" ".join(f"p{rng.randrange(60)}" for _ in range(rng.choice((1, 2, 5, 9, 10, 14, 60)))) for _ in range(25)]
    texts = ["".join(rng.choice(pool) + rng.choice((". ", "!\n", "\n", " ")) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    texts = list(dict.fromkeys(texts))
    want = brute_lines_lost(texts)
    rows = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert [WORD.findall(rows[k]) for k in range(len(texts))] == want


def test_line_dedup_compares_contents_where_all_hashes_are_equal(spark, monkeypatch):
    rng = random.Random(36)
    pool = [" ".join(f"q{rng.randrange(60)}" for _ in range(rng.choice((2, 5, 10, 14, 60)))) for _ in range(15)]
    texts = ["".join(rng.choice(pool) + rng.choice((". ", "\n")) for _ in range(rng.randrange(1, 8))) for _ in range(20)]
    texts = list(dict.fromkeys(texts))
    for name in ("hash", "xxhash64"):
        constant = getattr(line_dedup.F, name)(line_dedup.F.lit(0))
        monkeypatch.setattr(line_dedup.F, name, lambda *_, constant=constant: constant)
    rows = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert [WORD.findall(rows[k]) for k in range(len(texts))] == brute_lines_lost(texts)


def test_line_dedup_chooses_places_by_content(spark):
    rng = random.Random(46)
    words = lambda n: " ".join(f"w{rng.randrange(10**8)}" for _ in range(n))
    passage = words(40)
    texts = [f"{words(60 + k)} {passage} {words(30)}" for k in range(4)]
    places = line_dedup.once(line_dedup.chunks(line_dedup.F.col("text")), line_dedup._places)
    rows = table(spark, texts).select("doc_id", places.alias("p")).collect()
    shared = [{p["at"] - 60 - r["doc_id"] for p in r["p"] if 60 + r["doc_id"] <= p["at"] <= 95 + r["doc_id"]} for r in rows]
    assert all({i for i in range(k, k + 6)} & shared[0] for k in range(31))
    inner = [{i for i in s if 5 <= i <= 30} for s in shared]
    assert inner[0] == inner[1] == inner[2] == inner[3] and all(len(r["p"]) < 0.5 * (121 + r["doc_id"]) for r in rows)
    found = {r["id"]: len(r["found"]) for r in line_dedup.repeated_places(table(spark, texts)).collect()}
    assert set(found) == {0, 1, 2, 3} and all(9 <= n <= 36 for n in found.values())


def test_lines_of_long_texts_without_sentences(spark):
    texts = ["." * 1_000_000, "\n" * 300_000, "a.b" * 300_000, "a\n" * 100_000]
    rows = table(spark, texts).select("doc_id", line_dedup.F.size(line_dedup.chunks(line_dedup.F.col("text"))).alias("n")).collect()
    assert [r["n"] for r in sorted(rows)] == [1, 1, 1, 100_000]


def test_line_dedup_sees_through_blank_lines(spark):
    lines = ["Menu one", "Menu two", "Menu three", "a long line of more than ten words that stands alone here"]
    texts = ["\n".join(lines), "\n\n".join(lines), "\n \n\t\n".join(lines), "\n\nown\n\n" + lines[3]]
    rows = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert rows[0] == texts[0] and [rows[k].split() for k in (1, 2, 3)] == [[], [], ["own"]]


# --- 6


def brute_url(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    host, path = m[1].lower(), m[2]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = min(fits, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0] + r[1], r[2])) if fits else None
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(9)
    labels = ["a", "b", "example", "x-y", "com", "net", "org"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    rules = [(host(rng.randint(1, 3)), rng.choice(["", "/", "/en/", "/en/x"]), rng.choice(["allow", "block"])) for _ in range(40)]
    rules += [("com", "/", "block"), ("com", "/", "allow"), (None, "/", "block")]
    urls = [f"http://{host(rng.randint(1, 4))}{rng.choice(['', '/', '/en/x?q', '/en#f', '?u=/en/'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "://", "http://A.COM/", "http://com", "http://.com/", "http://com./", "http://com:80/", "HTTP://a.b\n/x"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id bigint, url string, row string")
    table_of_rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    rows = url_rules.judge(pages, table_of_rules).collect()
    assert len(rows) == len(urls)
    known = [r for r in rules if r[0]]
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_url(urls[r["page_id"]], known)
    assert {r["verdict"] for r in url_rules.judge(pages, table_of_rules.limit(0)).collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), table_of_rules).collect() == []


# --- 7


def test_warc_round_trip(spark):
    version = "\r\n\r\nWARC/1.1\r\n"
    html = ["a", None, "", "a", version, "WARC/1.1\r\nx", "é" * 70000 + version + "z" * 70000, "x" * 131072, "\r\n\r\n", "a\r\n\r\n"]
    pages = [(k, f"http://h/{k} x", h) for k, h in enumerate(html)] + [(None, None, "a"), (3, "again", "a"), (40, "y", "x" * 131072)]
    folder = scratch(spark, "warc")
    warc.write(spark.createDataFrame(pages, "page_id bigint, url string, html string"), folder)
    first = {}
    for k, _, h in pages:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    want = []
    for k, _, h in pages:
        data = (h or "").encode()
        again = k is not None and k > first[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((k, len(data), digest, "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(map(tuple, warc.read(spark, folder).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("body", ["x\r\n", "\r\n", "line\r\n\r\n", "ends in WARC/1.1", "WARC/1.1\r"])
def test_warc_pages_that_end_like_records(spark, body):
    """A megabyte of small pages, so that read buffers end at many places inside their blank lines."""
    pages = spark.range(12000).selectExpr("id AS page_id", "concat('http://h/', id) AS url", f"concat(id, repeat('y', int(id % 7)), '{body}') AS html")
    folder = scratch(spark, "warc")
    warc.write(pages.coalesce(2), folder)
    got = warc.read(spark, folder).selectExpr("count(*) AS n", "count(DISTINCT page_id) AS ids", "sum(payload_bytes) AS size").first()
    assert tuple(got) == (12000, 12000, pages.selectExpr("sum(octet_length(html))").first()[0])


def test_warc_of_a_large_payload(spark):
    pages = spark.range(2).selectExpr("id AS page_id", "'u' AS url", "repeat(concat('é', id, 'WARC/1.1'), 3000000) AS html")
    folder = scratch(spark, "warc")
    warc.write(pages, folder)
    sizes = {r["page_id"]: r["payload_bytes"] for r in warc.read(spark, folder).collect()}
    assert sizes == {0: 33000000, 1: 33000000}
    assert warc.read(spark, folder).filter("record_type = 'revisit'").count() == 0


# --- 8


BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
}


def brute_secrets(text):
    found = [
        (m.start(), k, kind, m.end())
        for k, (kind, (pattern, group, least)) in enumerate(BASE.items())
        for m in pattern.finditer(text or "")
        if len(m.group(group)) >= least
    ]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


SECRET_TEXTS = [
    *EDGES,
    "🙂 é token = 'abcdefgh12345678' and PASSWORD:short password: token: abcdefghij",
    "api_key=" + "0a" * 20 + " AKIA" + "B" * 12 + " AKIA" + "C" * 11 + "AKIAAKIA" + "9" * 12,
    "f" * 31 + "g" + "f" * 32,
    "secret==========",
    "🙂 é token = 'abcdefgh12345678' and PASSWORD:short password: token: abcdefghij",
]


def test_secrets_match_the_patterns_and_the_ledger_grows(spark):
    ledger, docs = scratch(spark, "ledger"), table(spark, SECRET_TEXTS)
    secrets.scan(docs, ledger)
    rows = secrets.findings(docs, ledger)
    assert rows.columns == ["doc_id", "row", "pieces", "secret_spans"]
    for r in rows.collect():
        assert [(s["kind"], s["begin"], s["end"]) for s in r["secret_spans"]] == brute_secrets(SECRET_TEXTS[r["doc_id"]])
    n = secrets.read_ledger(spark, ledger).count()
    assert n == 3 * len({t or "" for t in SECRET_TEXTS})
    secrets.scan(docs, ledger)
    assert secrets.read_ledger(spark, ledger).count() == n
    newer = (*secrets.RULES[:2], secrets.RULES[2]._replace(version=2, pattern="[0-9a-f]{16,}", valid=".{16,}"))
    secrets.scan(docs, ledger, newer)
    assert secrets.read_ledger(spark, ledger).count() == n + n // 3
    old = secrets.findings(docs, ledger).filter("doc_id = 9").collect()[0]["secret_spans"]
    assert [(s["kind"], s["begin"], s["end"]) for s in old] == brute_secrets(SECRET_TEXTS[9])


# --- 9


def test_pseudonyms_keep_format_validity_and_links(spark):
    texts = [
        None,
        "",
        "card 4041894974608795 and 4041-8949-7460-8795, bad 4041894974608796",
        "call +1 (988) 555-2485 or 988-555-2485; ssn 123-45-6789, 000-12-1234",
        "bosbt.42@mail8.example.com from 42.144.35.254 not 300.1.1.1 on 2024-02-29, 2023-02-29",
        "29.02.2024 02/29/2024 1799-12-31",
    ]
    docs = table(spark, texts)
    out = pseudonyms.pseudonymise(docs, "key")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [rows[k]["text"] for k in (0, 1)] == [None, ""]
    counts = [[rows[k][f"n_{kind}"] for kind in pseudonyms.KINDS] for k in range(6)]
    assert counts == [[0] * 6, [0] * 6, [0, 2, 0, 0, 0, 0], [0, 0, 2, 1, 0, 0], [1, 0, 0, 0, 1, 1], [0, 0, 0, 0, 0, 2]]
    a, b = re.findall(r"\d[\d-]{15,}", rows[2]["text"])[:2]
    assert a == b.replace("-", "") != "4041894974608795" and rows[2]["text"].endswith("bad 4041894974608796")
    digits = [int(c) for c in reversed(a)]
    assert sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
    for k, text in enumerate(texts):
        if text:
            shape = lambda t: re.sub("[a-z]", "a", re.sub(r"\d+", lambda m: "9" * (len(m[0]) if "." not in t else 1), t))
            assert shape(rows[k]["text"]) == shape(text)
    back = pseudonyms.pseudonymise(out.select("doc_id", "text"), "key", undo=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))
    other = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(docs, "another").collect()}
    assert other[2] != rows[2]["text"]
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise(docs, "")


def test_pseudonyms_of_phones_outside_the_plan_times_and_short_mailboxes(spark):
    texts = [
        "+1 (017) 555-7713, 117-055-7713 and 1.217.155.7713",
        "at 2024-02-29T10:00Z and 2024-02-29t1000, not 2024-02-29Tue",
        "a@x.org, A@X.org, 7@x.org, a@y.org; _@x.org",
    ]
    texts += [f"({area:03d}) 555-7713" for area in range(0, 1000, 37)]
    out = pseudonyms.pseudonymise(table(spark, texts), "key")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [rows[0]["n_phone"], rows[1]["n_date"], rows[2]["n_email"]] == [3, 2, 4]
    assert all(rows[k]["n_phone"] == 1 and rows[k]["text"] != texts[k] for k in range(3, len(texts)))
    assert not re.search("017|7713", rows[0]["text"]) and re.sub(r"\d", "9", rows[0]["text"]) == re.sub(r"\d", "9", texts[0])
    day = re.findall(r"\d{4}-\d{2}-\d{2}", rows[1]["text"])
    assert day[0] == day[1] != "2024-02-29" == day[2] and "T10:00Z" in rows[1]["text"]
    old, new = (re.findall(r"(\w)@", t) for t in (texts[2], rows[2]["text"]))
    assert all(a != b for a, b in zip(old[:4], new[:4], strict=True)) and new[0] == new[1].lower() and new[4] == "_"
    back = pseudonyms.pseudonymise(out.select("doc_id", "text"), "key", undo=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))


def test_feistel_is_a_permutation(spark):
    grid = [(a, b) for a in range(7) for b in range(11)]
    rows = spark.createDataFrame(grid, "a int, b int")
    from pyspark.sql import functions as F

    moved = rows.select(pseudonyms.permute(F.array("a", "b"), F.array(F.lit(7), F.lit(11)), "t", "k").alias("v")).collect()
    assert sorted(tuple(r["v"]) for r in moved) == sorted(grid)


# --- 10


@pytest.fixture(scope="module")
def vocabulary():
    return piece_sampling.load()


def test_pieces_decode_to_the_text(spark, vocabulary):
    rng = random.Random(11)
    texts = [*EDGES, "Hello  world ▁\x00 日本語 🙂\r\n", *("".join(rng.choice("ab é▁🙂\n") for _ in range(200)) for _ in range(20))]
    docs = table(spark, texts)
    encoded = piece_sampling.encode(docs, vocabulary)
    decoded = piece_sampling.decode(encoded, vocabulary)
    assert {r["doc_id"]: r["decoded"] for r in decoded.collect()} == dict(enumerate(texts))
    again = piece_sampling.encode(docs.repartition(7), vocabulary)
    assert {r["doc_id"]: r["pieces"] for r in again.collect()} == {r["doc_id"]: r["pieces"] for r in encoded.collect()}
    assert encoded.columns == ["doc_id", "text", "row", "pieces"]


def test_segmentations_come_with_their_weight(vocabulary):
    pieces = {bytes(vocabulary.data[vocabulary.offsets[i] : vocabulary.offsets[i + 1]]): (int(i), w) for i, w in zip(vocabulary.ids, vocabulary.weights, strict=True)}

    def every(text):
        if not text:
            return {(): 1.0}
        out = {}
        for n in range(1, len(text) + 1):
            if text[:n] in pieces:
                i, w = pieces[text[:n]]
                out |= {(i, *rest): math.exp(w) * p for rest, p in every(text[n:]).items()}
        return out

    want = every(b" there")
    total, n = sum(want.values()), 60_000
    keys = mix(np.arange(n).astype(U64))
    ids, counts = piece_sampling.sample(texts_of(pa.array([" there"] * n)), keys, vocabulary, 1)
    got = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1]))
    assert sum(abs(got[s] / n - p / total) for s, p in want.items()) < 0.02


# --- names that clash, and many matches


def test_columns_named_like_results(spark):
    row = (1, "token = abcdefgh1234 mail a@x.org", "b", "s", 5, "p")
    docs = spark.createDataFrame([row, (None, None, None, None, None, None)], "doc_id bigint, text string, blob string, secret_spans string, n_email int, pseudonyms string")
    ledger = scratch(spark, "ledger")
    secrets.scan(docs, ledger)
    found = secrets.findings(docs, ledger)
    assert found.columns == ["doc_id", "blob", "n_email", "pseudonyms", "secret_spans"]
    kept = {r["doc_id"]: r for r in found.collect()}
    assert kept[1]["blob"] == "b" and len(kept[1]["secret_spans"]) == 1 and kept[None]["secret_spans"] == []
    hidden = pseudonyms.pseudonymise(docs, "k")
    assert hidden.columns[:5] == ["doc_id", "text", "blob", "secret_spans", "pseudonyms"]
    rows = {r["doc_id"]: r for r in hidden.collect()}
    assert rows[1]["pseudonyms"] == "p" and rows[1]["n_email"] == 1 and "a@x.org" not in rows[1]["text"]
    assert rows[None]["text"] is None and rows[None]["n_email"] == 0
    assert secrets.findings(docs.limit(0), ledger).collect() == [] and pseudonyms.pseudonymise(docs.limit(0), "k").collect() == []


def test_urls_with_columns_named_like_results(spark):
    urls = spark.createDataFrame([(1, "http://a.net/x", "h", 7)], "page_id bigint, url string, host string, rule int")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    got = url_rules.judge(urls, rules)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert [tuple(r) for r in got.collect()] == [(1, "a.net", "/x", "net/", "block")]


def test_many_matches_in_one_text(spark):
    text = "".join(f"é{'x' * (k % 7)}, {k} " for k in range(20000))
    want = [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]
    docs = spark.createDataFrame([(text,), ("",), ("12",)], "text string")
    got = [[tuple(m) for m in r["m"]] for r in docs.select(spans.matches(docs["text"], "[0-9]+").alias("m")).collect()]
    assert got == [want, [], [(0, 2, "12")]]
