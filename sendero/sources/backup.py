"""Device backups: own addresses and edited places as one JSON document per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.datasets import is_edited
from ..operators.roads import dense_ids


class Backup:
    """Contents of backup files. ``files`` tells which were readable."""

    def __init__(self, files: DataFrame, addresses: DataFrame, edits: DataFrame):
        self.files = files
        self.addresses = addresses
        self.edits = edits


def _is(value: Column, path: str, kind: str) -> Column:
    found = F.try_variant_get(value, path, "variant")
    return F.coalesce(F.startswith(F.schema_of_variant(found), F.lit(kind)), F.lit(False))


def _string(value: Column, name: str) -> Column:
    """A text field; any other type counts as missing."""
    return F.when(_is(value, f"$.{name}", "STRING"), F.try_variant_get(value, f"$.{name}", "string"))


def _list(value: Column, path: str) -> Column:
    return F.when(_is(value, path, "ARRAY"), F.try_variant_get(value, path, "array<variant>"))


def read_backup(spark: SparkSession, path: str) -> Backup:
    """A bare list of addresses or {addresses, placeEdits}. Other files are marked, not fatal.

    addresses(source, file_pos, id, name, address, notes, lat, lng, created_at, updated_at) and
    edits(source, file_pos, town, id, name, partida, num, ref, lat, lng, address, notes,
    updated_at) fit ``import_addresses`` and ``import_edits``; coordinates are still text.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("source"), F.try_parse_json("value").alias("doc")
    )
    doc = F.col("doc")
    read = raw.select(
        "source",
        F.coalesce(_list(doc, "$"), _list(doc, "$.addresses")).alias("addresses"),
        _list(doc, "$.placeEdits").alias("edits"),
    )
    known = F.col("addresses").isNotNull() | F.col("edits").isNotNull()
    files = read.select("source", known.alias("accepted"))
    entry = F.col("e")
    number = lambda n: F.try_variant_get(entry, f"$.{n}", "string").alias(n)
    listed = lambda c: read.select("source", F.posexplode(c).alias("pos", "e")).select(
        "source", F.col("pos").cast("bigint").alias("file_pos"), "e"
    )
    addresses = listed("addresses").select(
        "source",
        "file_pos",
        *[_string(entry, n).alias(n) for n in ("id", "name", "address", "notes")],
        number("lat"),
        number("lng"),
        _string(entry, "createdAt").alias("created_at"),
        _string(entry, "updatedAt").alias("updated_at"),
    )
    edits = listed("edits").select(
        "source",
        "file_pos",
        _string(entry, "town").alias("town"),
        _string(entry, "id").alias("id"),
        *[F.try_variant_get(entry, f"$.{n}", "string").alias(n) for n in ("name", "partida", "num")],
        _string(entry, "ref").alias("ref"),
        number("lat"),
        number("lng"),
        *[_string(entry, n).alias(n) for n in ("address", "notes")],
        _string(entry, "updatedAt").alias("updated_at"),
    )
    return Backup(files, addresses, edits)


def _address() -> Column:
    return F.struct(
        "id", "name", "address", "notes", "lat", "lng",
        F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"),
    )


def _edit() -> Column:
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return F.struct(
        "id", "town", "name", "partida", "num", "lat", "lng", blank("ref"), blank("address"), blank("notes"),
        "edited", F.col("updated_at").alias("updatedAt"),
    )


def _as_json(app: str, version: int, exported_at: str) -> Column:
    """A document of ``addresses`` and ``edits``; placeEdits only when there are any."""
    head = [F.lit(app).alias("app"), F.lit(version).alias("version"), F.lit(exported_at).alias("exportedAt")]
    some = F.when(F.size("edits") > 0, F.col("edits")).alias("placeEdits")
    return F.to_json(F.struct(*head, "addresses", some)).alias("value")


def backup_document(
    addresses: DataFrame, places: DataFrame, app: str, version: int, exported_at: str
) -> DataFrame:
    """(value): the backup of one device as JSON text; placeEdits only when there are any."""
    own = addresses.agg(F.array_sort(F.collect_list(_address())).alias("addresses"))
    edits = places.filter(is_edited()).agg(F.array_sort(F.collect_list(_edit())).alias("edits"))
    return own.join(edits).select(_as_json(app, version, exported_at))


def write_backup(
    addresses: DataFrame,
    places: DataFrame,
    path: str,
    app: str,
    version: int,
    exported_at: str,
    part_rows: int = 100_000,
) -> None:
    """Backup files of at most ``part_rows`` rows, each a whole document; ``read_backup`` reads the folder.

    What a person saved makes one file. More rows make more files, in the order of ids.
    """
    own = addresses.select(F.lit("address").alias("kind"), "id", _address().alias("address"))
    edited = places.filter(is_edited()).select(F.lit("edit").alias("kind"), "id", _edit().alias("edit"))
    placed = dense_ids(own.unionByName(edited, allowMissingColumns=True), ["kind", "id"], "place")

    def in_order(kind: str) -> Column:
        mine = F.when(F.col("kind") == kind, F.struct("place", kind))
        return F.transform(F.array_sort(F.collect_list(mine)), lambda x: x[kind])

    parts = placed.groupBy(F.floor(F.col("place") / part_rows).alias("part")).agg(
        in_order("address").alias("addresses"), in_order("edit").alias("edits")
    )
    documents = parts.select(_as_json(app, version, exported_at))
    if documents.isEmpty():
        documents = backup_document(addresses, places, app, version, exported_at)
    documents.write.option("maxRecordsPerFile", 1).text(path)
