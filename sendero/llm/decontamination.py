"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton takes the items word by word (ASCII lower-cased runs of digits, letters and non-ASCII
characters). Documents are streamed through it: after each word it knows the longest run of words,
ending there, that some item contains. A run of ``window`` words (or a whole item, where it has
fewer) is an occurrence; its words are hit, and what the hits amount to decides.

Only the automaton is broadcast. It has at most two states per item word, and ``build`` refuses more
than ``max_words`` item words; beyond that, items go through in blocks (``decontaminate`` joins the
hits of the blocks), so nothing is left out.

Nulls: a null text has no words; items with null or no words are never found; a null item id is
listed as nothing but its words still hit. Equal items each count. Rows repeat as they come. Without
items nothing is hit.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import in_arrow, slices

WINDOW = 13
COVERAGE = 20  # hit words times this reach the document's words: contaminated
MAX_WORDS = 2_000_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Automaton:
    """States of a generalised suffix automaton over words, with what they tell about items.

    ``steps[s]`` maps a word to the next state, ``link[s]`` is the state of the longest suffix in
    another class, ``longest[s]`` the length of the state's longest run.
    """

    def __init__(self, items: Iterable[tuple[int | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.steps: list[dict[bytes, int]] = [{}]
        self.link, self.longest = [-1], [0]
        ends: dict[int, set[int]] = defaultdict(set)  # items with a run of this state
        self.whole: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (length, item) of short items
        self.items: list[int | None] = []
        for name, words in items:
            if not words:
                continue
            number, last = len(self.items), 0
            self.items.append(name)
            for word in words:
                last = self._extend(last, word)
                ends[last].add(number)
            if len(words) < window:
                self.whole[last].append((len(words), number))
        order = sorted(range(1, len(self.link)), key=lambda s: -self.longest[s])
        for state in order:  # an item that has a run has all its suffixes
            ends[self.link[state]] |= ends[state]
        #: items by the state that holds their run of ``window`` words
        self.windows = {
            s: sorted(ends[s]) for s in order if self.longest[self.link[s]] < window <= self.longest[s]
        }
        self.ends_whole = [False] * len(self.link)  # some short item ends here or on the way to the root
        for state in reversed(order):
            self.ends_whole[state] = state in self.whole or self.ends_whole[self.link[state]]

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.steps[last]:
            known = self.steps[last][word]
            if self.longest[known] == self.longest[last] + 1:
                return known
            return self._split(last, word, known)
        new = self._state(self.longest[last] + 1, {})
        at = last
        while at != -1 and word not in self.steps[at]:
            self.steps[at][word] = new
            at = self.link[at]
        if at == -1:
            self.link[new] = 0
        else:
            known = self.steps[at][word]
            exact = self.longest[known] == self.longest[at] + 1
            self.link[new] = known if exact else self._split(at, word, known)
        return new

    def _state(self, longest: int, steps: dict[bytes, int]) -> int:
        self.steps.append(steps)
        self.longest.append(longest)
        self.link.append(0)
        return len(self.link) - 1

    def _split(self, at: int, word: bytes, known: int) -> int:
        """A state for the shorter runs of ``known``, those that ``at`` leads to."""
        copy = self._state(self.longest[at] + 1, dict(self.steps[known]))
        self.link[copy] = self.link[known]
        self.link[known] = copy
        while at != -1 and self.steps[at].get(word) == known:
            self.steps[at][word] = copy
            at = self.link[at]
        return copy

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        """(end, length, items): runs of ``words`` that are a window or a whole short item."""
        steps, link, longest, whole = self.steps, self.link, self.longest, self.ends_whole
        window, state, length = self.window, 0, 0
        for end, word in enumerate(words, 1):
            known = steps[state].get(word)
            while known is None and state:
                state = link[state]
                length = longest[state]
                known = steps[state].get(word)
            if known is None:
                continue
            state = known
            length += 1
            if length >= window or whole[state]:
                at = state
                while at:
                    for size, item in self.whole.get(at, ()):
                        if size <= length:
                            yield end, size, [item]
                    if longest[link[at]] < window <= length and longest[at] >= window:
                        yield end, window, self.windows[at]
                    at = link[at]


def build(items: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> list[Automaton]:
    """One automaton per block of at most ``max_words`` item words of ``items(item_id, text)``."""
    out, block, size = [], [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        words = item_words(row["text"])
        if size and size + len(words) > max_words:
            out.append(Automaton(block, window))
            block, size = [], 0
        block.append((row["item_id"], words))
        size += len(words)
    return [*out, Automaton(block, window)]


HITS = "n_words bigint, n_hit bigint, spans array<struct<begin:int,end:int>>, items array<bigint>"


def _stream(automaton: Automaton):
    """Arrow function: a row's key to its words, hit words, hit spans (in words) and items."""

    def run(batches):
        for part, texts in slices(batches):
            data = bytes(texts.data)
            out = []
            for row in range(len(texts)):
                words = _WORD.findall(data[texts.offsets[row] : texts.offsets[row + 1]].lower())
                spans: list[list[int]] = []
                found: set[int] = set()
                for end, length, items in automaton.occurrences(words):
                    begin = end - length
                    while spans and begin <= spans[-1][1]:
                        begin = min(begin, spans.pop()[0])
                    spans.append([begin, end])
                    found.update(items)
                names = [automaton.items[i] for i in found if automaton.items[i] is not None]
                out.append((len(words), sum(e - b for b, e in spans), [{"begin": b, "end": e} for b, e in spans], names))
            columns = [
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.int64()),
                pa.array([x[2] for x in out], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                pa.array([x[3] for x in out], pa.list_(pa.int64())),
            ]
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names), *columns], [*names, "n_words", "n_hit", "spans", "items"]
            )

    return run


def hits(docs: DataFrame, automaton: Automaton, *carried: str) -> DataFrame:
    """``carried`` columns, n_words, n_hit, spans [begin, end) in words, and the ids of found items."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return in_arrow(docs.select(*carried, "text"), _stream(automaton), f"{kinds}, {HITS}" if kinds else HITS)


def _merge(spans):
    """Spans of several blocks as disjoint ones."""
    begin = lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<begin:int,end:int>>"),
        lambda acc, s: F.when(F.size(acc) == 0, F.array(begin(s)))
        .when(
            F.element_at(acc, -1)["end"] >= s["begin"],
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["begin"].alias("begin"),
                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        )
        .otherwise(F.concat(acc, F.array(begin(s)))),
    )


def measured(docs: DataFrame, automata: list[Automaton]) -> DataFrame:
    """(row, n_words, n_hit, spans, items): the hits of all blocks, ``row`` holding docs' columns."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(HITS).fields])
    out = in_arrow(rows, _stream(automata[0]), schema)
    for more in automata[1:]:
        again = out.select(F.struct("*").alias("was"), F.col("row.text").alias("text"))
        kind = T.StructType([again.schema["was"], *T._parse_datatype_string(HITS).fields])
        out = in_arrow(again, _stream(more), kind).select(
            "was.row",
            "n_words",
            _merge(F.concat("was.spans", "spans")).alias("spans"),
            F.array_union("was.items", "items").alias("items"),
        )
        total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
        out = out.select("row", "n_words", total.alias("n_hit"), "spans", "items")
    return out


def contaminated(coverage: int = COVERAGE):
    """True where hits reach the coverage limit: n_hit > 0 and coverage * n_hit >= n_words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words"))


def keep_clean(docs: DataFrame, automata: list[Automaton], coverage: int = COVERAGE) -> DataFrame:
    """The documents under the coverage limit, with all their columns."""
    return measured(docs, automata).filter(~contaminated(coverage)).select("row.*")


def cut_spans(docs: DataFrame, automata: list[Automaton], min_words: int = WINDOW) -> DataFrame:
    """All documents with the hit spans of at least ``min_words`` words cut out of ``text``."""
    rows = measured(docs, automata).select("row", "spans", F.col("row.text").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("cut", T.StringType())])
    cut = in_arrow(rows, _cut(min_words), schema)
    return cut.select(*[F.col("cut").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _cut(min_words: int):
    def run(batches):
        for part, texts in slices(batches):
            data, out = bytes(texts.data), []
            for row, spans in enumerate(part.column("spans").to_pylist()):
                text = data[texts.offsets[row] : texts.offsets[row + 1]]
                long = [(s["begin"], s["end"]) for s in spans or () if s["end"] - s["begin"] >= min_words]
                if long:
                    at = [m.span() for m in _WORD.finditer(text.lower())]
                    last, pieces = 0, []
                    for begin, end in long:
                        pieces.append(text[last : at[begin][0]])
                        last = at[end - 1][1]
                    text = b"".join([*pieces, text[last:]])
                out.append(text.decode() if part.column("text")[row].is_valid else None)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out, pa.string())], ["row", "cut"])

    return run
