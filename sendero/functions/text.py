"""Text functions: accent folding, tokens, slugs, haystacks, parcel references, labels."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx

# Whitespace as the search box understands it. Java's plain \s is ASCII only.
SPACE_CLASS = (
    "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def strip(c: Column | str) -> Column:
    """Trim every kind of Unicode whitespace."""
    return F.regexp_replace(as_col(c), "(?U)^\\s+|\\s+$", "")


@lru_cache(maxsize=None)
def _folding(all_marks: bool) -> tuple[str, str]:
    """Letters whose canonical decomposition is one letter plus marks -> that letter."""
    source, target = [], []
    for code in range(0xC0, 0x30000):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if parts == char:
            continue
        kept = [p for p in parts if not _is_mark(p, all_marks)]
        if len(kept) == 1:
            source.append(char)
            target.append(kept[0])
    return "".join(source), "".join(target)


def _is_mark(char: str, all_marks: bool) -> bool:
    return bool(unicodedata.combining(char)) if all_marks else "\u0300" <= char <= "\u036f"


@lru_cache(maxsize=None)
def _mark_class(all_marks: bool) -> str:
    if not all_marks:
        return "[\\u0300-\\u036f]"
    marks = [c for c in range(0x300, 0x1E950) if unicodedata.combining(chr(c))]
    starts = [c for c in marks if c - 1 not in set(marks)]
    ends = [c for c in marks if c + 1 not in set(marks)]
    # most characters are below the marks and need not be compared with every range
    return "(?![\\x00-\\u02FF])[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends)) + "]"


def fold_accents(c: Column | str, all_marks: bool = False) -> Column:
    """Letters without their marks. Text of single bytes has none and stays as it is."""
    source, target = _folding(all_marks)
    plain = F.octet_length(as_col(c)) == F.char_length(as_col(c))
    folded = F.regexp_replace(F.translate(as_col(c), source, target), _mark_class(all_marks), "")
    return F.when(plain, as_col(c)).otherwise(folded)


def normalize(c: Column | str) -> Column:
    """Accent-free lower case; null becomes the empty string."""
    return F.lower(fold_accents(F.coalesce(as_col(c).cast("string"), F.lit(""))))


def tokenize(c: Column | str) -> Column:
    return F.filter(F.split(normalize(c), SPACE_CLASS + "+"), lambda t: t != "")


def parse_query(c: Column | str) -> Column:
    """struct<name_tokens, num_filter>: a last all-digit token becomes the number filter."""
    return let(tokenize(c), _split_number)


def _split_number(tokens: Column) -> Column:
    last = F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))
    has_num = last.rlike("^[0-9]+$")
    return F.struct(
        F.when(has_num, F.slice(tokens, F.lit(1), F.size(tokens) - 1))
        .otherwise(tokens)
        .alias("name_tokens"),
        F.when(has_num, last).otherwise(F.lit("")).alias("num_filter"),
    )


def matches_all(hay: Column | str, tokens: Column | str) -> Column:
    hay = as_col(hay)
    return F.forall(as_col(tokens), lambda t: F.contains(hay, t))


def num_prefix(num: Column | str, prefix: Column | str) -> Column:
    return F.startswith(F.coalesce(as_col(num), F.lit("")), as_col(prefix))


def without_number(num: Column | str) -> Column:
    """True for anything that does not start with a digit (S/N and friends)."""
    return ~F.coalesce(as_col(num), F.lit("")).rlike("^[0-9]")


def slugify(c: Column | str) -> Column:
    plain = F.lower(F.replace(fold_accents(c, all_marks=True), F.lit("'"), F.lit(" ")))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))


def parcel_ref(local_id: Column | str) -> Column:
    """Cadastral reference: what follows the last dot of the address local id."""
    return F.coalesce(strip(F.substring_index(as_col(local_id), ".", -1)), F.lit(""))


def parcel_ref_label(ref: Column | str, label: Column | None = None) -> Column:
    """Rural reference -> polygon and parcel; urban one -> its known label or the reference.

    ``label`` is a column with the looked-up designator; without it the built-in list is used.
    """
    cleaned = F.upper(strip(F.coalesce(as_col(ref), F.lit(""))))
    return let(cleaned, lambda r: _ref_label(r, label))


def _ref_label(ref: Column, label: Column | None) -> Column:
    if label is None:
        label = F.try_element_at(literal_map(fx.REF_LABELS), ref)
    rural = "^\\d{5}[A-Z](\\d{3})(\\d{5})[0-9A-Z]*$"
    number = lambda group: F.regexp_extract(ref, rural, group).try_cast("bigint").cast("string")
    return (
        F.when(ref == "", F.lit(None).cast("string"))
        .when(
            ref.rlike(rural),
            F.concat(F.lit("Políg. "), number(1), F.lit(" · Parc. "), number(2)),
        )
        .otherwise(F.coalesce(label, F.concat(F.lit("Ref. "), ref)))
    )


def parcel_compact(ref: Column | str) -> Column:
    """'Políg. 20 · Parc. 295' -> '20-295'; 'Ref. X' -> 'X'."""
    return let(strip(F.coalesce(as_col(ref), F.lit(""))), _compact)


def _compact(text: Column) -> Column:
    numbers = F.regexp_extract_all(text, F.lit("(\\d+)"), 1)
    bare = strip(F.regexp_replace(text, "(?i)^\\s*ref\\.?\\s*", ""))
    return F.when(
        text.rlike("(?iu)pol[ií]g") & text.rlike("(?i)parc") & (F.size(numbers) >= 2),
        F.array_join(F.slice(numbers, 1, 2), "-"),
    ).otherwise(F.when(bare == "", text).otherwise(bare))


def haystack(*cols: Column | str) -> Column:
    blank = [F.coalesce(as_col(c).cast("string"), F.lit("")) for c in cols]
    return normalize(F.concat_ws(" ", *blank))


def place_haystack(name="name", partida="partida", num="num", ref="ref", address="address", notes="notes"):
    return haystack(name, partida, num, ref, parcel_compact(ref), address, notes)


def own_haystack(name="name", address="address", notes="notes") -> Column:
    return haystack(name, address, notes)


def address_signature(name: Column | str, lat: Column | str, lng: Column | str) -> Column:
    fixed = f"%.{fx.COORD_DECIMALS}f"
    return F.concat_ws(
        "|",
        strip(normalize(name)),
        F.format_string(fixed, as_col(lat)),
        F.format_string(fixed, as_col(lng)),
    )


def _filled(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def place_subtitle(address, ref, num, town_label) -> Column:
    town_label = as_col(town_label)
    return F.coalesce(
        _filled(address),
        _filled(ref),
        F.when(without_number(num), F.concat(F.lit("Casa sin número · "), town_label)),
        F.concat(town_label, F.lit(" · Catastro")),
    )


def default_address(partida, num, town_label) -> Column:
    return F.concat(as_col(partida), F.lit(" "), as_col(num), F.lit(", "), as_col(town_label))


# Spanish alphabetical order. A collated copy of the text used only as a sort key.
def spanish(c: Column | str) -> Column:
    return F.collate(as_col(c), "es")


def natural_key(c: Column | str) -> Column:
    """Sort key of house numbers: digit-leading first, digit runs by value, then Spanish order."""
    text = F.coalesce(as_col(c), F.lit(""))

    def by_value(run: Column) -> Column:
        """A digit run with its length in front, so that longer numbers follow shorter ones."""
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(F.rlike(run, F.lit("^[0-9]")), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(run)

    runs = F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    keyed = F.array_join(F.transform(runs, by_value), "")
    return F.struct(without_number(text).alias("last"), spanish(keyed).alias("text"), text.alias("raw"))
