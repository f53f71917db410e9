"""Format-preserving pseudonyms of numbers, dates and addresses by a keyed Feistel permutation.

A valid value is read as digits of mixed radix (a card's inner digits, a day within 400 years, the four
bytes of an address), permuted by ``ROUNDS`` Feistel rounds whose keyed function is SHA-256, and
written back in the format it came in. The permutation depends on the kind, the value and the key
alone: equal values stay linked across documents, however they are punctuated, and with the key
``undo`` gets the values back (a day or month written without a leading zero may come back with one). What fails its check (a card's Luhn digit, a day that does not exist) stays as it is.

Kinds, tried in this order at each place: e-mail (letters and digits of the local part; a single one is
shifted by a keyed function of the domain), card (13 to 19 digits with a valid Luhn digit: issuer digit
kept, Luhn digit made anew), phone (ten digits in the formats of the North American plan; the first digits
of area and exchange stay within 2 to 9, or within 0 and 1 for numbers outside the plan), social security
number, IPv4 address, date (ISO, d.m.yyyy, m/d/yyyy, also before T and a time; years 1800 to 2199, which are
a whole cycle of the calendar).

Nulls: a null text stays null with no values. Repeated rows get equal texts. All other columns are
carried. An empty key is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import once

ROUNDS = 6
KINDS = ("email", "card", "phone", "ssn", "ipv4", "date")
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ipv4": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?:(?![0-9A-Za-z/-]|\.[0-9])|(?=[Tt][0-9]{2}:?[0-9]{2}))",
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
CYCLE = (189, 773)  # 146097 days in 400 years


def _ints(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("int"))


def permute(values: Column, radix: Column, kind: str, key: str, undo: bool = False) -> Column:
    """The Feistel permutation of array<int> ``values``, value i being below radix i; two halves at least.

    Each round adds to one half a keyed function of the other; ``undo`` takes it away again.
    """
    half = F.greatest(F.floor(F.size(values) / 2).cast("int"), F.lit(1))
    rest = F.size(values) - half
    shape = "struct<l:array<int>,r:array<int>>"
    halves = F.struct(F.slice(values, F.lit(1), half).alias("l"), F.slice(values, half + 1, rest).alias("r"))
    bases = F.struct(F.slice(radix, F.lit(1), half).alias("l"), F.slice(radix, half + 1, rest).alias("r"))

    def add(mine: Column, other: Column, base: Column, number: Column) -> Column:
        said = F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))

        def one(x: Column, i: Column) -> Column:
            drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", said, i.cast("string")), 256), 1, 12), 16, 10).cast("bigint")
            m = F.get(base, i)
            return F.pmod(x - drawn % m if undo else x + drawn % m, m).cast("int")

        return F.transform(mine, one)

    def step(acc: Column, number: Column) -> Column:
        left = F.struct(add(acc["l"], acc["r"], bases["l"], number).alias("l"), acc["r"].alias("r"))
        right = F.struct(acc["l"].alias("l"), add(acc["r"], acc["l"], bases["r"], number).alias("r"))
        return F.when(number % 2 == 0, left).otherwise(right).cast(shape)

    order = list(range(ROUNDS))
    rounds = F.array(*[F.lit(k) for k in (reversed(order) if undo else order)])
    return F.aggregate(rounds, halves.cast(shape), step, lambda acc: F.concat(acc["l"], acc["r"]))


def _chars(s: Column) -> Column:
    return F.split(s, "", -1)


def _digits(s: Column) -> Column:
    return _ints(_chars(F.regexp_replace(s, "[^0-9]", "")))


def _fill(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced in order."""
    one = lambda c, i: F.when(
        c.between("0", "9"),
        F.get(digits, F.length(F.regexp_replace(F.substring(pattern, F.lit(1), i + 1), "[^0-9]", "")) - 1).cast("string"),
    ).otherwise(c)
    return F.array_join(F.transform(_chars(pattern), one), "")


def _radix(digits: Column, base) -> Column:
    return F.transform(digits, lambda _, i: base(i) if callable(base) else F.lit(base))


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right but one doubled; valid if a multiple of ten."""
    n = F.size(digits)
    return F.aggregate(
        F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)),
        F.lit(0),
        lambda a, d: a + d,
    )


def _card(s: Column, key: str, undo: bool) -> Column:
    def body(d: Column) -> Column:
        inner = F.slice(d, F.lit(2), F.size(d) - 2)
        moved = permute(inner, _radix(inner, 10), "card", key, undo)

        def close(first: Column) -> Column:
            check = (10 - _luhn(F.concat(first, F.array(F.lit(0)))) % 10) % 10
            return _fill(s, F.concat(first, F.array(check)))

        return F.when(_luhn(d) % 10 == 0, once(F.concat(F.slice(d, F.lit(1), F.lit(1)), moved), close))

    return once(_digits(s), body)


def _phone(s: Column, key: str, undo: bool) -> Column:
    def body(d: Column) -> Column:
        country = F.slice(d, F.lit(1), F.size(d) - 10)
        ten = F.slice(d, F.size(d) - 9, F.lit(10))
        first = lambda i: (i == 0) | (i == 3)
        low = lambda x, i: F.when(first(i) & (x > 1), F.lit(2)).otherwise(F.lit(0))
        base = lambda x, i: F.when(first(i), F.when(x > 1, F.lit(8)).otherwise(F.lit(2))).otherwise(F.lit(10))
        values = F.transform(ten, lambda x, i: x - low(x, i))
        moved = permute(values, F.transform(ten, base), "phone", key, undo)
        return _fill(s, F.concat(country, F.transform(moved, lambda x, i: x + low(F.get(ten, i), i))))

    return once(_digits(s), body)


def _ssn(s: Column, key: str, undo: bool) -> Column:
    area, group, serial = (F.substring(s, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    radix = F.array(F.lit(898), F.lit(99), F.lit(9999))

    def write(v: Column) -> Column:
        first = F.when(F.get(v, F.lit(0)) >= 665, F.get(v, F.lit(0)) + 2).otherwise(F.get(v, F.lit(0)) + 1)
        return F.format_string("%03d-%02d-%04d", first, F.get(v, F.lit(1)) + 1, F.get(v, F.lit(2)) + 1)

    return F.when(valid, once(permute(values, radix, "ssn", key, undo), write))


def _ipv4(s: Column, key: str, undo: bool) -> Column:
    def body(v: Column) -> Column:
        valid = F.forall(v, lambda x: x < 256) & (F.array_join(F.transform(v, lambda x: x.cast("string")), ".") == s)
        moved = permute(v, _radix(v, 256), "ipv4", key, undo)
        return F.when(valid, F.array_join(F.transform(moved, lambda x: x.cast("string")), "."))

    return once(_ints(F.split(s, r"\.", -1)), body)


def _date(s: Column, key: str, undo: bool) -> Column:
    n = _ints(F.split(s, "[./-]", -1))
    iso, dots = s.contains("-"), s.contains(".")

    def body(ymd: Column) -> Column:
        y, m, d = (F.get(ymd, F.lit(k)) for k in range(3))
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        valid = y.between(1800, 2199) & m.between(1, 12) & d.between(1, days)
        day = F.datediff(F.make_date(y, m, d), F.lit("1800-01-01").cast("date"))
        values = F.array(F.floor(day / CYCLE[1]).cast("int"), (day % CYCLE[1]).cast("int"))

        def write(v: Column) -> Column:
            at = F.date_add(F.lit("1800-01-01").cast("date"), F.get(v, F.lit(0)) * CYCLE[1] + F.get(v, F.lit(1)))
            return (
                F.when(iso, F.date_format(at, "yyyy-MM-dd"))
                .when(dots, F.when(s.rlike(r"^[0-9]{2}\.[0-9]{2}\."), F.date_format(at, "dd.MM.yyyy")).otherwise(F.date_format(at, "d.M.yyyy")))
                .otherwise(F.when(s.rlike("^[0-9]{2}/[0-9]{2}/"), F.date_format(at, "MM/dd/yyyy")).otherwise(F.date_format(at, "M/d/yyyy")))
            )

        moved = permute(values, F.array(*[F.lit(x) for x in CYCLE]), "date", key, undo)
        return F.when(valid, once(moved, write))

    a, b, c = (F.get(n, F.lit(k)) for k in range(3))
    return once(F.when(iso, F.array(a, b, c)).when(dots, F.array(c, b, a)).otherwise(F.array(c, a, b)), body)


def _email(s: Column, key: str, undo: bool) -> Column:
    local = F.substring_index(s, "@", 1)
    code = lambda c: F.ascii(c)
    low = lambda c: F.when(c.between("0", "9"), 48).when(c.between("A", "Z"), 65).when(c.between("a", "z"), 97).otherwise(code(c))
    size = lambda c: F.when(c.between("0", "9"), 10).when(c.between("A", "Z") | c.between("a", "z"), 26).otherwise(1)

    def body(chars: Column) -> Column:
        values = F.transform(chars, lambda c: code(c) - low(c))
        moved = permute(values, F.transform(chars, size), "email", key, undo)
        back = F.zip_with(moved, chars, lambda v, c: F.chr(v + low(c)))
        return F.concat(F.array_join(back, ""), F.substring(s, F.length(local) + 1, F.lit(1 << 20)))

    def single(c: Column) -> Column:
        domain = F.lower(F.substring(s, 2, 1 << 20))
        said = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), domain), 256)
        shift = 1 + F.conv(F.substring(said, 1, 12), 16, 10).cast("bigint") % F.greatest(size(c) - 1, F.lit(1))
        moved = F.pmod(code(c) - low(c) - shift if undo else code(c) - low(c) + shift, size(c)).cast("int")
        return F.when(size(c) > 1, F.concat(F.chr(moved + low(c)), F.substring(s, 2, 1 << 20)))

    return F.when(F.length(local) > 1, once(_chars(local), body)).otherwise(once(local, single))


_CHANGES = {"email": _email, "card": _card, "phone": _phone, "ssn": _ssn, "ipv4": _ipv4, "date": _date}


def _named(kind: str):
    return lambda text: F.when(text.isNotNull(), F.struct(F.lit(kind).alias("kind"), text.alias("text")))


def _of(kind: str):
    return lambda change: change["kind"] == kind


def _change(s: Column, key: str, undo: bool) -> Column:
    """struct<kind, text>: a match and what it becomes; kind is null where it stays."""
    out = F.lit(None).cast("struct<kind:string,text:string>")
    for kind in reversed(KINDS):
        made = once(_CHANGES[kind](s, key, undo), _named(kind))
        out = F.when(s.rlike(f"^(?:{PATTERNS[kind]})$"), made).otherwise(out)
    return F.coalesce(out, F.struct(F.lit(None).cast("string").alias("kind"), s.alias("text")))


def pseudonymise(docs: DataFrame, key: str, column: str = "text", undo: bool = False) -> DataFrame:
    """docs with the values in ``column`` replaced, plus n_<kind> bigint for each kind.

    Columns of docs that are named like those counts give way; all others are carried, whatever their names.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.col(column)
    changed = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda s: _change(s, key, undo))
    both = F.struct(changed.alias("new"), F.split(text, ANY, -1).alias("between"))
    others = [c for c in docs.columns if c not in [f"n_{kind}" for kind in KINDS]]
    numbered = [F.col(c).alias(f"_{k}") for k, c in enumerate(others)]
    rows = docs.select(*numbered, F.when(text.rlike(ANY), both).alias("found"))
    text = F.col(f"_{others.index(column)}")

    def join(new: Column, between: Column) -> Column:
        # zip_with pads the shorter side: the last piece has no match after it
        return F.array_join(F.zip_with(between, new, lambda p, n: F.concat(p, F.coalesce(n["text"], F.lit("")))), "")

    out = F.when(F.col("found").isNull(), text).otherwise(join(F.col("found.new"), F.col("found.between")))
    counts = [
        F.coalesce(F.size(F.filter("found.new", _of(kind))), F.lit(0)).cast("bigint").alias(f"n_{kind}") for kind in KINDS
    ]
    return rows.select(*[(out if c == column else F.col(f"_{k}")).alias(c) for k, c in enumerate(others)], *counts)
