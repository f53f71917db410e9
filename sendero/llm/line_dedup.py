"""Line dedup by content-defined places and equal neighbours.

A line ends at a newline or, within longer lines, after the mark that ends a sentence. What stands at
more than one place in the table is removed everywhere but at the first (smallest doc_id, then place):

* every line of ``MIN_WORDS`` words or more,
* every run of two or more lines with words, whatever their length,
* within lines of more than ``LONG_WORDS`` words, every run of ``MIN_WORDS`` words or more.

It is enough to compare single long lines, pairs of neighbouring lines of which one is short, and all runs of
``MIN_WORDS`` words of very long lines, since every longer run is a union of these. So a repeated passage loses
all its whole lines, wherever it stands; the parts of lines at its two ends stay where their lines have no more
than ``LONG_WORDS`` words. At least one copy of each line is kept.

1. Every unit (a line, or a word of a very long line) is hashed once. Contents choose places that do not move with
   what stands before: a long line, two short lines together, and in very long lines the smallest rolling hash
   of ``ROLL`` words among the ``MIN_WORDS - ROLL + 1`` of each run. So every run to be compared holds a place.
2. Only hashes of places move, to find those that stand more than once in the table.
3. There, and over the neighbouring lines and words, contents are cut and ranked among their copies byte by byte.

Nulls: a null text stays null; a null doc_id counts as the largest. Rows with equal id and text are
treated alike (both keep or both lose a line). Other columns are carried. Lines are compared without
the blanks around them; blank lines belong to the line before them and make no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import once

BLANK_LINES = r"[\x20\t\x0B-\x0D]*+(?:\n|\z)"  # belong to the line before
LINE = rf"(?!\z)(?:[^\n.!?]++|\n(?={BLANK_LINES})|[.!?](?!\x20(?!{BLANK_LINES})))*+(?:\n|[.!?]\x20|\z)"
WORD = r"(?!\z)[^\x20\x09-\x0D]*+[\x20\x09-\x0D]*+"
MIN_WORDS = 10
LONG_WORDS = 50
ROLL = 5
PLACE_BITS = 28
BLANK = " \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1


def _at_least(line: Column, words: int) -> Column:
    shape = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{words - 1}}}[^\x20\x09-\x0D]"
    return (F.length(line) >= 2 * words - 1) & line.rlike(shape)


def _bare(unit: Column) -> Column:
    """What is compared: a line or word without the blanks around it."""
    return F.btrim(unit, F.lit(BLANK))


def chunks(text: Column) -> Column:
    """array<array<string>>: the lines of a text, each one unit or, if very long, its words; laid end to end, the text."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(LINE), F.lit(0)),
        lambda line: F.when(
            _at_least(line, LONG_WORDS + 1), F.regexp_extract_all(line, F.lit(WORD), F.lit(0))
        ).otherwise(F.array(line)),
    )


def _lines(lines: Column) -> Column:
    """array<struct<c,n,long,words,at>>: the bare line, its units, whether it is long, words to roll over, first unit."""

    def facts(line: Column) -> Column:
        very = F.size(line) > 1

        def of(c: Column) -> Column:
            ten = F.when(_at_least(c, MIN_WORDS) & ~_at_least(c, MIN_WORDS + 1), F.split(c, "\x20", -1))  # may equal a run
            words = F.when(very, F.transform(line, _bare)).otherwise(once(ten, lambda w: F.when(F.size(w) == MIN_WORDS, w)))
            return F.struct(c.alias("c"), F.size(line).alias("n"), (very | _at_least(c, MIN_WORDS)).alias("long"), words.alias("words"))

        return once(_bare(F.when(very, F.array_join(line, "")).otherwise(F.get(line, F.lit(0)))), of)

    def starts(known: Column) -> Column:
        line = F.flatten(F.transform(known, lambda x, k: F.array_repeat(k, x["n"])))
        first = F.sequence(F.lit(0), F.size(known) - 1)
        inner = once(
            line,
            lambda of: F.filter(
                F.sequence(F.lit(0), F.size(of) - 1), lambda u: (u == 0) | (F.get(of, u) != F.get(of, u - 1))
            ),
        )
        return F.when(F.exists(known, lambda x: x["n"] > 1), inner).otherwise(first)

    def placed(known: Column) -> Column:
        return once(
            starts(known), lambda begins: F.transform(known, lambda x, k: x.withField("at", F.get(begins, k)))
        )

    return once(F.transform(lines, facts), placed)


def _rolled(words: Column) -> Column:
    """array<struct<h,i>>: the rolling hash of ROLL words at the places that runs of MIN_WORDS words choose."""
    wide = MIN_WORDS - ROLL + 1

    def chosen(rolling: Column) -> Column:
        # the lowest bits hold the place; equal hashes are decided by it, so that equal runs choose alike
        marked = F.transform(rolling, lambda h, i: h.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("bigint")))
        least = once(
            marked,
            lambda m: F.transform(
                F.sequence(F.lit(1), F.size(m) - wide + 1), lambda s: F.array_min(F.slice(m, s, F.lit(wide)))
            ),
        )
        at = F.transform(F.array_distinct(least), lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
        return F.transform(at, lambda i: F.struct(F.get(rolling, i).alias("h"), i.alias("i")))

    def roll(hashes: Column) -> Column:
        return once(
            F.transform(
                F.sequence(F.lit(0), F.size(hashes) - ROLL),
                lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(ROLL))),
            ),
            chosen,
        )

    return once(F.transform(words, lambda w: F.xxhash64(w)), roll)


def _places(lines: Column) -> Column:
    """array<struct<h,at>>: the places that contents choose, as unit and hash."""

    def made(known: Column) -> Column:
        def of(line: Column, k: Column) -> Column:
            def with_next(after: Column) -> Column:
                place = lambda h, at: F.struct(h.alias("h"), at.cast("bigint").alias("at"))
                inside = F.transform(
                    _rolled(line["words"]), lambda r: place(r["h"], F.when(line["n"] > 1, line["at"] + r["i"]).otherwise(line["at"]))
                )
                pair = F.when(
                    ~after["long"] & (line["c"] != "") & (after["c"] != ""), F.array(place(F.xxhash64(line["c"], after["c"]), line["at"]))
                )
                return (
                    F.when(line["words"].isNotNull(), inside)
                    .when(line["long"], F.array(place(F.xxhash64(line["c"]), line["at"])))
                    .otherwise(pair)
                )

            return once(F.get(known, k + 1), with_next)

        return F.flatten(F.array_compact(F.transform(known, of)))

    return once(_lines(lines), made)


def _runs(lines: Column, found: Column) -> Column:
    """array<struct<content,spot>>: what stands at ``found`` (units, ascending) and over its neighbours; spot holds unit and size."""
    none = "0" * (MIN_WORDS - ROLL + 1)
    gaps = F.transform(found, lambda u, j: F.concat(F.repeat(F.lit("0"), (u - F.coalesce(F.get(found, j - 1), F.lit(-1)) - 1).cast("int")), F.lit("1")))
    flags = F.concat(F.array_join(gaps, ""), F.repeat(F.lit("0"), F.size(F.flatten(lines)))).cast("binary")

    def run(at: Column, n: Column, content: Column) -> Column:
        spot = F.shiftleft(at.cast("bigint"), 32) + n.cast("bigint")
        return F.struct(content.alias("content"), spot.alias("spot"))

    def made(known: Column, bits: Column) -> Column:
        def hit(line: Column) -> Column:
            some = F.substring(bits, line["at"] + 1, line["n"])
            return F.instr(some.cast("string"), F.lit("1")) > 0

        def of(line: Column, k: Column) -> Column:
            def with_next(after: Column) -> Column:
                alone = F.when(line["long"] & (line["n"] == 1) & hit(line), F.array(run(line["at"], line["n"], line["c"])))
                known_pair = F.when(line["long"], hit(line)).when(after["long"], hit(after)).otherwise(hit(line))
                pair = F.when(
                    (~line["long"] | ~after["long"]) & (line["c"] != "") & (after["c"] != "") & known_pair,
                    F.array(run(line["at"], line["n"] + after["n"], F.concat_ws("\n", line["c"], after["c"]))),
                )
                starts = F.filter(
                    F.sequence(F.lit(0), line["n"] - MIN_WORDS),
                    lambda i: F.substring(bits, line["at"] + i + 1, F.lit(len(none))) != F.lit(none).cast("binary"),
                )
                inner = F.when(
                    line["n"] > 1,
                    F.transform(
                        starts,
                        lambda i: run(line["at"] + i, F.lit(MIN_WORDS), F.array_join(F.slice(line["words"], i + 1, F.lit(MIN_WORDS)), " ")),
                    ),
                )
                return F.flatten(F.array_compact(F.array(alone, pair, inner)))

            return once(F.get(known, k + 1), with_next)

        return F.flatten(F.transform(known, of))

    return once(_lines(lines), lambda known: once(flags, lambda bits: made(known, bits)))


def _id(name: str) -> Column:
    return F.coalesce(name, F.lit(LAST)).cast("bigint")


def _meet(docs: DataFrame, facts: DataFrame, how: str) -> tuple[DataFrame, str]:
    """docs with the facts of their id and version, and what the facts' names begin with. Both joins read docs alike, so that texts move once."""
    mark = "fact_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark = "_" + mark
    facts = facts.withColumnsRenamed({c: mark + c for c in facts.columns})
    return docs.join(facts, (_id("doc_id") == F.col(mark + "id")) & (F.xxhash64("text") == F.col(mark + "version")), how), mark


def repeated_places(docs: DataFrame) -> DataFrame:
    """(id, version, found): per text the places whose hash stands more than once in the table."""
    rows = docs.filter(F.length("text") > 0).select(
        _id("doc_id").alias("id"),
        F.xxhash64("text").alias("version"),
        F.explode_outer(once(chunks(F.col("text")), _places)).alias("p"),  # the outer form adds no filter that cuts again
    )
    rows = rows.select("id", "version", "p.h", "p.at").filter("at IS NOT NULL")
    again = rows.withColumn("n", F.count("*").over(Window.partitionBy("h"))).filter("n > 1")
    return again.groupBy("id", "version").agg(F.sort_array(F.collect_set("at")).alias("found"))


def removed(docs: DataFrame) -> DataFrame:
    """(id, version, places): the units that each row loses, in order."""
    rows, mark = _meet(docs, repeated_places(docs), "inner")
    runs = once(chunks(F.col("text")), lambda lines: _runs(lines, F.col(mark + "found")))
    rows = rows.select(F.col(mark + "id").alias("id"), F.col(mark + "version").alias("version"), F.explode_outer(runs).alias("r"))
    rows = rows.select("id", "version", "r.*").filter("spot IS NOT NULL")
    copies = Window.partitionBy("content").orderBy("id", "spot", "version")
    lost = rows.withColumn("rank", F.rank().over(copies)).filter("rank > 1")
    spots = lost.groupBy("id", "version").agg(F.collect_list("spot").alias("spots"))

    def units(spot: Column) -> Column:
        at = F.shiftright(spot, 32)
        return F.sequence(at, at + spot.bitwiseAND(F.lit((1 << 32) - 1)) - 1)

    places = F.transform(F.sort_array(F.array_distinct(F.flatten(F.transform("spots", units)))), lambda x: x.cast("int"))
    return spots.select("id", "version", places.alias("places"))


def _without(text: Column, places: Column) -> Column:
    """The text without the units at ``places`` (ascending): what is kept is sliced out between them."""

    def kept(parts: Column) -> Column:
        ends = F.concat(places, F.array(F.size(parts)))

        def runs(all_ends: Column) -> Column:
            def run(end: Column, k: Column) -> Column:
                begin = F.coalesce(F.get(all_ends, k - 1) + 1, F.lit(0))
                return F.slice(parts, begin + 1, end - begin)

            return F.transform(all_ends, run)

        return F.array_join(F.flatten(once(ends, runs)), "")

    return once(F.flatten(chunks(text)), kept)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines and runs of words removed from ``text``, plus n_removed (lines, or words of very long lines)."""
    joined, mark = _meet(docs, removed(docs), "left")
    lost = F.col(mark + "places")
    text = F.when(lost.isNull(), F.col("text")).otherwise(_without(F.col("text"), lost))
    fields = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*fields, F.coalesce(F.size(lost), F.lit(0)).cast("bigint").alias("n_removed"))
