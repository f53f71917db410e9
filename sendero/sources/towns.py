"""Published town datasets and their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.datasets import upsert_manifest
from ..operators.roads import dense_ids

PLACE = "struct<id: string, name: string, partida: string, num: string, lat: double, lng: double, ref: string>"
TOWN = f"id string, name string, source string, sourceDate string, version int, count int, places array<{PLACE}>"
TOWN_ENTRY = "id: string, name: string, file: string, version: int, count: int, sourceDate: string"
ARTIFACT = "struct<file: string, version: int, size: bigint>"
MANIFEST = f"struct<towns: array<struct<{TOWN_ENTRY}>>, basemap: {ARTIFACT}, graph: {ARTIFACT}>"
MANIFEST_FILE = "index.json"
PLACE_COLUMNS = ["id", "name", "partida", "num", "lat", "lng", "ref"]


def read_town_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per published document; the manifest in the same folder is skipped."""
    docs = spark.read.schema(TOWN).json(folder, multiLine=True)
    return docs.filter(~F.endswith(F.input_file_name(), F.lit(f"/{MANIFEST_FILE}")))


def read_towns(spark: SparkSession, folder: str) -> DataFrame:
    """(town, version, source_date, id, name, partida, num, lat, lng, ref)."""
    docs = read_town_documents(spark, folder)
    rows = docs.select(
        F.col("id").alias("town"),
        "version",
        F.col("sourceDate").alias("source_date"),
        F.explode("places").alias("p"),
    )
    return rows.select("town", "version", "source_date", "p.*")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], f"m {MANIFEST}")
    return spark.read.text(path, wholetext=True).select(F.from_json("value", MANIFEST).alias("m"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(towns, artifacts); both are empty for a missing or corrupt manifest."""
    manifest = _manifest(spark, path)
    towns = manifest.select(F.explode("m.towns").alias("t")).select("t.*")
    named = F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(f"m.{n}").alias("a")) for n in ("basemap", "graph")]
    )
    artifacts = manifest.select(F.explode(named).alias("x")).filter("x.a IS NOT NULL")
    return towns, artifacts.select("x.name", "x.a.*")


def write_towns(places: DataFrame, headers: DataFrame, folder: str) -> None:
    """The dataset at any size: places as JSON rows in one folder per town, headers beside.

    places(town, id, ...), headers(id, name, source, sourceDate, version). Rows of a town are
    spread over as many files as it needs.
    """
    counts = places.groupBy(F.col("town").alias("id")).agg(F.count("*").cast("int").alias("count"))
    headers.join(counts, "id", "left").withColumn("count", F.coalesce("count", F.lit(0))).write.json(
        f"{folder}/headers"
    )
    rows = places.select("town", *PLACE_COLUMNS)
    (
        rows.repartitionByRange("town", "partida", "num", "id")
        .sortWithinPartitions("town", "partida", "num", "id")
        .write.partitionBy("town")
        .option("maxRecordsPerFile", 1_000_000)
        .json(f"{folder}/places")
    )


def read_written_towns(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(places, headers) as written by ``write_towns``."""
    schema = "town string, id string, name string, partida string, num string, lat double, lng double, ref string"
    header = "id string, name string, source string, sourceDate string, version int, count int"
    return (
        spark.read.schema(schema).json(f"{folder}/places"),
        spark.read.schema(header).json(f"{folder}/headers"),
    )


def write_town_documents(
    places: DataFrame, headers: DataFrame, folder: str, part_places: int = 200_000
) -> None:
    """JSON documents for devices: one per town, or several for a town of more than ``part_places``.

    Each document has the town's header, the number of its own places and its part number, from 0. Together
    the parts hold the whole town in order; ``read_towns`` reads them like one document.
    """
    order = ["town", "partida", "num", "id"]
    placed = dense_ids(places.select("town", *PLACE_COLUMNS), order, "place")
    first = placed.groupBy("town").agg(F.min("place").alias("first"))
    parts = placed.join(first, "town").withColumn("part", F.floor((F.col("place") - F.col("first")) / part_places).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("place", F.struct(*PLACE_COLUMNS).alias("p"))))
    listed = parts.groupBy(F.col("town").alias("id"), "part").agg(
        F.count("*").cast("int").alias("count"), F.transform(ordered, lambda x: x["p"]).alias("places")
    )
    docs = headers.join(listed, "id").select(
        F.col("id").alias("file"), "id", "name", "source", "sourceDate", "version", "part", "count", "places"
    )
    docs.write.partitionBy("file").option("maxRecordsPerFile", 1).json(folder)


def write_manifest(towns: DataFrame, artifacts: DataFrame, entries: DataFrame, path: str) -> None:
    """Manifest with the entries of these towns replaced: one small JSON document.

    It has one line per town, which bounds it by the number of towns in the country.
    """
    merged = upsert_manifest(towns, entries)
    entry = F.struct(*[F.col(c) for c in ("id", "name", "file", "version", "count", "sourceDate")])
    order = F.struct(F.coalesce("name", F.lit("")).alias("n"), entry.alias("e"))
    listed = merged.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["e"]).alias("towns"))
    fields = F.struct("file", "version", "size")
    shared = artifacts.agg(
        *[F.max(F.when(F.col("name") == n, fields)).alias(n) for n in ("basemap", "graph")]
    )
    document = listed.join(shared).select(F.to_json(F.struct("towns", "basemap", "graph")))
    document.coalesce(1).write.text(path)
