"""Streams of GPS fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIX = "session_id bigint, ts timestamp, fix_id bigint, lat double, lng double, accuracy double, speed double, heading double"


def read_fixes(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Fixes from a folder that files are added to, or any other streaming source format."""
    reader = spark.readStream.format(format).options(**options)
    if format in ("parquet", "json", "csv", "orc"):
        reader = reader.schema(FIX)
    return reader.load(path) if path else reader.load()
