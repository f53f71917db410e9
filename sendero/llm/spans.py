"""Matches of a pattern with their places, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


BLOCK_BITS = 8


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _before(sizes: Column, body) -> Column:
    """body(f) with f(i) the sum of the first i sizes: whole blocks of 256, then what is left. Linear in practice."""
    block = 1 << BLOCK_BITS
    last = F.greatest(F.shiftright(F.size(sizes) - 1, BLOCK_BITS), F.lit(0))
    sums = F.transform(F.sequence(F.lit(0), last), lambda b: _sum(F.slice(sizes, b * block + 1, F.lit(block))))
    offsets = once(sums, lambda s: F.transform(s, lambda _, b: _sum(F.slice(s, F.lit(1), b))))

    def upto(known: Column):
        def of(i: Column) -> Column:
            b = F.shiftright(i, BLOCK_BITS)
            return F.get(known, b) + _sum(F.slice(sizes, b * block + 1, i - b * block))

        return body(of)

    return once(offsets, upto)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<begin,end,match>>: leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between matches and the matches themselves, laid in turn, are the text; their running
    lengths are the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def placed(ms: Column, lengths: Column) -> Column:
        def one(before):
            def of(m: Column, i: Column) -> Column:
                return once(
                    before(i) + F.get(lengths, i),
                    lambda end: F.struct((end - F.char_length(m)).alias("begin"), end.alias("end"), m.alias("match")),
                )

            return F.transform(ms, of)

        return _before(lengths, one)

    pair = F.struct(found.alias("m"), between.alias("b"))

    def sized(p: Column) -> Column:
        lengths = F.transform(p["m"], lambda m, i: (F.char_length(F.get(p["b"], i)) + F.char_length(m)).cast("bigint"))
        return once(lengths, lambda known: placed(p["m"], known))

    return once(pair, sized)
