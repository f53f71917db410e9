"""Connected components by alternating star contractions over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..plans.session import cut


def connected_components(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vertex, comp): comp is the smallest vertex of the component.

    ``pairs(a, b)`` are undirected links, ``vertices(vertex)`` lists every vertex. Large-star and
    small-star rounds need a logarithmic number of passes whatever the diameter, and each pass is
    one partially aggregated minimum plus an equi-join, so no vertex's neighbours meet in a task.
    """
    links = cut(_ordered(pairs.select("a", "b")), "links")
    before, mark = None, _fingerprint(links)
    while mark != before and mark["n"] > 0:
        links = cut(_small_star(_large_star(links)), "links")
        before, mark = mark, _fingerprint(links)
    # links now hold (larger vertex, root) for every vertex that is not its own root
    return vertices.join(links.withColumnRenamed("a", "vertex"), "vertex", "left").select(
        "vertex", F.coalesce("b", "vertex").alias("comp")
    )


def _ordered(pairs: DataFrame) -> DataFrame:
    """Links as (larger, smaller), no loops, no repeats."""
    return (
        pairs.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the vertex's smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    larger = links.select(F.col("b").alias("a"), F.col("a").alias("large"))
    return _ordered(larger.join(lowest, "a").select(F.col("large").alias("a"), F.col("low").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex itself, go to the smallest one."""
    lowest = links.groupBy("a").agg(F.min("b").alias("low"))
    joined = links.join(lowest, "a")
    return _ordered(
        joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            lowest.select("a", F.col("low").alias("b"))
        )
    )


def _fingerprint(links: DataFrame) -> Row:
    return links.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()


def component_sizes(components: DataFrame) -> DataFrame:
    """(comp, n, share, largest): share of all vertices; ties go to the smallest comp."""
    sizes = components.groupBy("comp").agg(F.count("*").alias("n"))
    total = sizes.agg(
        F.sum("n").alias("total"), F.min_by("comp", F.struct(-F.col("n"), "comp")).alias("top")
    )
    return sizes.join(total).select(
        "comp",
        "n",
        (F.col("n") / F.col("total")).alias("share"),
        (F.col("comp") == F.col("top")).alias("largest"),
    )
