"""Cadastral GML: addresses and thoroughfare names, many municipality files in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# explicit schemas: inference would read an id such as T1 as a timestamp
ADDRESS = """
_id string,
inspireId struct<Identifier: struct<localId: string>>,
position array<struct<GeographicPosition: struct<geometry: struct<Point: struct<_srsName: string, pos: string>>>>>,
locator array<struct<AddressLocator: struct<designator: array<struct<LocatorDesignator: struct<designator: string>>>>>>,
component array<struct<_href: string>>
"""
_SPELLING = "struct<GeographicalName: struct<spelling: struct<SpellingOfName: struct<text: string>>>>"
THOROUGHFARE = f"""
_id string,
name struct<ThoroughfareNameValue: struct<name: {_SPELLING}>, GeographicalName: struct<spelling: struct<SpellingOfName: struct<text: string>>>>
"""


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return (
        spark.read.format("xml")
        .option("rowTag", tag)
        .option("ignoreNamespace", True)
        .schema(schema)
        .load(path)
        .withColumn("municipality", _municipality())
    )


def _municipality() -> Column:
    """The five-digit code in a file name such as A.ES.SDGC.AD.03059.gml."""
    return F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), "(\\d{5})", 1)


def read_gml_addresses(spark: SparkSession, path: str) -> DataFrame:
    """(municipality, addr_id, tn_refs, number, x, y, local_id, srs).

    The first designator with text is the number. Rows without a point or a designator are
    dropped, references keep their order.
    """
    rows = _rows(spark, path, "Address", ADDRESS)
    points = F.filter(
        F.transform("position", lambda p: p["GeographicPosition"]["geometry"]["Point"]),
        lambda p: p["pos"].isNotNull(),
    )
    point = F.try_element_at(points, F.lit(1))
    places = F.flatten(
        F.filter(
            F.transform("locator", lambda a: a["AddressLocator"]["designator"]),
            lambda d: d.isNotNull(),
        )
    )
    numbers = F.filter(
        F.transform(places, lambda d: d["LocatorDesignator"]["designator"]),
        lambda n: F.coalesce(n, F.lit("")) != "",
    )
    hrefs = F.filter(
        F.transform(F.coalesce("component", F.array()), lambda c: c["_href"]),
        lambda h: F.coalesce(h, F.lit("")) != "",
    )
    parsed = rows.select(
        "municipality",
        F.col("_id").alias("addr_id"),
        F.transform(hrefs, lambda h: F.ltrim(h, F.lit("#"))).alias("tn_refs"),
        strip(F.try_element_at(numbers, F.lit(1))).alias("number"),
        F.split(strip(point["pos"]), "\\s+").alias("xy"),
        strip("inspireId.Identifier.localId").alias("local_id"),
        point["_srsName"].alias("srs"),
    )
    at = lambda i: F.try_element_at("xy", F.lit(i)).try_cast("double")
    return (
        parsed.withColumns({"x": at(1), "y": at(2)})
        .filter("number IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
        .select("municipality", "addr_id", "tn_refs", "number", "x", "y", "local_id", "srs")
    )


def read_gml_thoroughfares(spark: SparkSession, path: str) -> DataFrame:
    """(municipality, gml_id, name)."""
    rows = _rows(spark, path, "ThoroughfareName", THOROUGHFARE)
    text = "GeographicalName.spelling.SpellingOfName.text"
    name = strip(F.coalesce(f"name.ThoroughfareNameValue.name.{text}", f"name.{text}"))
    named = rows.select("municipality", F.col("_id").alias("gml_id"), name.alias("name"))
    return named.filter("gml_id IS NOT NULL AND name <> ''")
