"""OpenStreetMap extracts: tiles of ways, restriction relations and nodes as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.datasets import dedup_last

FIELDS = {
    "way": "type: string, id: bigint, tags: map<string,string>, geometry: array<struct<lat: double, lon: double>>",
    "relation": "type: string, id: bigint, tags: map<string,string>, members: array<struct<type: string, ref: bigint, role: string>>",
    "node": "type: string, id: bigint, lat: double, lon: double",
}


def _elements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Elements of one kind from files that are element lists or {"elements": [...]} answers.

    Tiles overlap; of an element found in several the last tile's wins.
    """
    element = FIELDS[kind]
    flat = ", ".join(part.replace(": ", " ", 1) for part in _split_fields(element))
    rows = spark.read.schema(f"{flat}, elements array<struct<{element}>>").json(path, multiLine=True)
    names = [part.split(":")[0].strip() for part in _split_fields(element)]
    one = F.array(F.struct(*names))
    found = rows.select(
        F.input_file_name().alias("tile"), F.explode(F.coalesce("elements", one)).alias("e")
    ).select("tile", "e.*")
    wanted = found.filter(F.col("type") == kind).drop("type")
    return dedup_last(wanted, ["id"], ["tile"]).drop("tile")


def _split_fields(text: str) -> list[str]:
    """Top-level fields of a struct type."""
    parts, depth = [""], 0
    for char in text:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += char
    return [part.strip() for part in parts]


def read_osm_ways(spark: SparkSession, path: str) -> DataFrame:
    """(id, tags, geometry)."""
    return _elements(spark, path, "way")


def read_osm_restrictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, tags, members)."""
    return _elements(spark, path, "relation")


def read_osm_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, lat, lon)."""
    return _elements(spark, path, "node")
