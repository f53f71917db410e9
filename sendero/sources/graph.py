"""Road graph tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..operators.roads import bbox


def write_graph(nodes: DataFrame, edges: DataFrame, bans: DataFrame, folder: str, build_date: str) -> None:
    """nodes, edges, bans and meta as Parquet, sorted along the Z curve for locality.

    Attribution and licence travel with the data in the meta table.
    """
    nodes.repartitionByRange("node_id").sortWithinPartitions("node_id").write.parquet(f"{folder}/nodes")
    edges.repartitionByRange("edge_id").sortWithinPartitions("edge_id").write.parquet(f"{folder}/edges")
    bans.repartitionByRange("via", "from_edge", "to_edge").sortWithinPartitions(
        "via", "from_edge", "to_edge"
    ).write.parquet(f"{folder}/bans")
    box = bbox(nodes, 0.0)
    counts = edges.agg(
        F.count("*").alias("edges"), (F.count("*") + F.count_if(~F.col("oneway"))).alias("directed_edges")
    )
    speeds = F.create_map(*[F.lit(x) for pair in fx.SPEED_KMH.items() for x in pair])
    meta = (
        box.join(nodes.agg(F.count("*").alias("nodes")))
        .join(counts)
        .join(bans.agg(F.count("*").alias("bans")))
        .withColumns(
            {
                "build_date": F.lit(build_date),
                "weight_unit": F.lit("centiseconds"),
                "speed_kmh": speeds,
                "attribution": F.lit(fx.ATTRIBUTION),
                "license": F.lit(fx.LICENSE),
            }
        )
    )
    meta.coalesce(1).write.parquet(f"{folder}/meta")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, bans, meta)."""
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("nodes", "edges", "bans", "meta"))
