"""Zone names: rural types, the display cleaner and the frozen cleaner behind place ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx
from .text import as_col, let, literal_map, slugify, strip


def rural_type(raw_name: Column | str) -> Column:
    """Thoroughfare code of a rural name, null for urban ones."""
    code = F.upper(F.substring_index(strip(raw_name), " ", 1))
    return F.when(code.isin(list(fx.RURAL_TYPES)), code)


def is_rural_pl(raw_name: Column | str, municipality: Column | str) -> Column:
    raw_name, municipality = as_col(raw_name), as_col(municipality).cast("string")
    listed = F.lit(False)
    for muni, zone in fx.RURAL_PL_ZONES:
        listed = listed | ((municipality == muni) & (strip(raw_name) == zone))
    return F.upper(raw_name).rlike("|".join(fx.RURAL_PL_KEYWORDS)) | listed


def is_rural(raw_name: Column | str, municipality: Column | str) -> Column:
    code = rural_type(raw_name)
    return code.isNotNull() & ((code != "PL") | is_rural_pl(raw_name, municipality))


def _words(name: Column) -> Column:
    return F.filter(F.split(name, "(?U)\\s+"), lambda w: w != "")


def _upper_first(part: Column) -> Column:
    return F.concat(F.upper(F.substring(part, 1, 1)), F.substr(part, F.lit(2)))


def _after_first(text: Column, separator: str) -> Column:
    start = F.instr(text, separator) + len(separator)
    return F.substr(text, start)


def title_case_es(name: Column | str) -> Column:
    """Spanish title case with saints, abbreviations, apostrophes, minor words and compounds."""
    return let(_words(as_col(name)), _title_words)


def _title_words(words: Column) -> Column:
    minor = fx.MINOR_WORDS
    # most words are none of these: they need one look-up and a capital
    special = {*fx.SAINT_ABBREVIATIONS, *fx.ABBREVIATIONS, *fx.PROPER_NOUN_ACCENTS, *(w.upper() for w in minor)}

    def capital(part: Column) -> Column:
        accented = F.try_element_at(literal_map(fx.PROPER_NOUN_ACCENTS), F.upper(part))
        return F.coalesce(accented, _upper_first(part))

    def compound(token: Column) -> Column:
        parts = F.split(token, "(?<=[-.])|(?=[-.])")
        first = F.length(token) - F.length(F.ltrim(token, F.lit("-.")))
        return F.array_join(
            F.transform(
                parts,
                lambda p, i: F.when((i > first) & p.isin(minor), p).otherwise(capital(p)),
            ),
            "",
        )

    def cased(word: Column, index: Column) -> Column:
        plain = ~word.rlike("[-.']") & ~F.upper(word).isin(sorted(special))
        return F.when(plain, _upper_first(F.lower(word))).otherwise(in_full(word, index))

    def in_full(word: Column, index: Column) -> Column:
        key = F.rtrim(F.upper(word), F.lit("."))
        following = F.coalesce(F.try_element_at(words, index + 2), F.lit(""))
        letters = F.length(F.regexp_replace(following, "\\P{L}", ""))
        saint = F.when(
            key.isin(list(fx.SAINT_ABBREVIATIONS)) & (letters >= 3),
            F.try_element_at(literal_map(fx.SAINT_ABBREVIATIONS), key),
        )
        low = F.lower(word)
        return F.coalesce(
            saint,
            F.try_element_at(literal_map(fx.ABBREVIATIONS), key),
            F.when(
                F.contains(low, F.lit("'")),
                F.concat(
                    F.substring_index(low, "'", 1), F.lit("'"), capital(_after_first(low, "'"))
                ),
            ),
            F.when((index > 0) & low.isin(minor), low),
            F.when(low.rlike("[-.]"), compound(low)),
            capital(low),
        )

    return F.array_join(F.transform(words, cased), " ")


def _article_first(name: Column) -> Column:
    """'BOCH, EL' and 'BOCH EL' -> 'EL BOCH'."""
    trailing = "(?ius)^(.*?) (" + "|".join(fx.TRAILING_ARTICLES) + ")$"
    return F.when(
        F.contains(name, F.lit(", ")),
        F.concat(_after_first(name, ", "), F.lit(" "), F.substring_index(name, ", ", 1)),
    ).otherwise(F.regexp_replace(name, trailing, "$2 $1"))


def _bare_name(raw_name: Column, code: Column) -> Column:
    def without_code(name: Column) -> Column:
        has_code = F.startswith(F.upper(name), F.concat(code, F.lit(" ")))
        return F.when(has_code, strip(F.substr(name, F.length(code) + 2))).otherwise(name)

    return let(strip(F.replace(raw_name, F.lit("&apos;"), F.lit("'"))), without_code)


def _with_type_word(zone: Column, code: Column) -> Column:
    word = F.try_element_at(literal_map(fx.RURAL_TYPES), code)
    fallback = F.try_element_at(literal_map(fx.FALLBACK_WORDS), code)
    starts_minor = F.lower(F.substring_index(zone, " ", 1)).isin(fx.MINOR_WORDS)
    lowered = F.concat(F.lower(F.substring(zone, 1, 1)), F.substr(zone, F.lit(2)))
    short = (zone != "") & (zone.rlike("^(?U)\\d") | (F.length(zone) <= 2))
    return (
        F.when(word != "", F.concat(word, F.lit(" "), F.when(starts_minor, lowered).otherwise(zone)))
        .when(short & fallback.isNotNull(), F.concat(fallback, F.lit(" "), zone))
        .otherwise(zone)
    )


def clean_zone(raw_name: Column | str, code: Column | str) -> Column:
    """Display name of a zone."""
    raw_name, code = as_col(raw_name), as_col(code)
    name = F.regexp_replace(_bare_name(raw_name, code), "(?i)\\s+GP\\.?\\s*\\d+\\s*$", "")
    zone = title_case_es(let(name, _article_first))
    return let(zone, lambda z: _with_type_word(z, code))


def _frozen_title_case(name: Column) -> Column:
    def cased(word: Column, index: Column) -> Column:
        head = F.substring_index(word, "'", 1)
        return (
            F.when(
                F.contains(word, F.lit("'")),
                F.concat(head, F.lit("'"), _upper_first(_after_first(word, "'"))),
            )
            .when((index > 0) & word.isin(fx.MINOR_WORDS), word)
            .otherwise(_upper_first(word))
        )

    return F.array_join(F.transform(_words(F.lower(name)), cased), " ")


def legacy_zone_slug(raw_name: Column | str, code: Column | str) -> Column:
    """Zone part of place ids. Frozen: improvements of display names must never reach it."""
    raw_name, code = as_col(raw_name), as_col(code)
    zone = _frozen_title_case(let(_bare_name(raw_name, code), _article_first))
    return slugify(let(zone, lambda z: _with_type_word(z, code)))
