"""Address ETL: raw cadastral addresses -> clean, deduplicated, geocoded places.

All municipalities run in one plan; ``municipality`` is part of every key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions import geo, names, text
from ..plans.session import cut
from .components import connected_components


def resolve_thoroughfare(addresses: DataFrame, thoroughfares: DataFrame) -> DataFrame:
    """Adds raw_name: the first reference, in order, that has a name. Others are dropped.

    addresses(addr_id, municipality, tn_refs, ...), thoroughfares(municipality, gml_id, name).
    """
    rest = [c for c in addresses.columns if c not in ("addr_id", "municipality", "tn_refs")]
    refs = addresses.select(
        "addr_id", "municipality", *rest, F.posexplode("tn_refs").alias("pos", "gml_id")
    )
    hits = refs.join(
        thoroughfares.select("municipality", "gml_id", F.col("name").alias("raw_name")),
        ["municipality", "gml_id"],
    )
    best = F.min_by(F.struct(*rest, "raw_name"), "pos").alias("best")
    return hits.groupBy("addr_id", "municipality").agg(best).select("addr_id", "municipality", "best.*")


def rural_addresses(addresses: DataFrame) -> DataFrame:
    """Rural rows with code, zone (display) and base (id slug). Needs raw_name, municipality."""
    zones = rural_zones(addresses.select("municipality", "raw_name").distinct())
    return addresses.join(zones, ["municipality", "raw_name"])


def rural_zones(thoroughfares: DataFrame) -> DataFrame:
    """Rural (municipality, raw_name) with code, zone, display and base.

    Names repeat over many addresses, so they are cleaned once each and joined back.
    """
    rural = thoroughfares.filter(names.is_rural("raw_name", "municipality"))
    named = rural.withColumn("code", names.rural_type("raw_name"))
    named = named.withColumn("zone", names.clean_zone("raw_name", "code"))
    named = with_canonical_zone(named.filter(F.col("zone") != ""), canonical_zones(thoroughfares))
    return named.withColumn("base", names.legacy_zone_slug("raw_name", "code"))


def canonical_zones(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        fx.CANONICAL_ZONE_NAMES, "municipality string, zone string, canonical string"
    )


def with_canonical_zone(df: DataFrame, renames: DataFrame) -> DataFrame:
    """Adds display: the reviewed name of (municipality, zone), else the zone itself."""
    renames = renames.select(
        F.col("municipality").alias("r_muni"), F.col("zone").alias("r_zone"), "canonical"
    )
    keys = (F.col("municipality").cast("string") == F.col("r_muni")) & (F.col("zone") == F.col("r_zone"))
    return (
        df.join(renames, keys, "left")
        .withColumn("display", F.coalesce("canonical", "zone"))
        .drop("r_muni", "r_zone", "canonical")
    )


def with_ref_label(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ref_label from a lookup table labels(ref, label)."""
    labels = labels.select(F.upper(text.strip("ref")).alias("l_ref"), "label")
    joined = df.join(labels, F.upper(text.strip("ref")) == F.col("l_ref"), "left")
    return joined.withColumn(
        "ref_label", text.parcel_ref_label("ref", text._filled("label"))
    ).drop("l_ref", "label")


def split_numbered(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered rows, rows without a house number)."""
    missing = F.col("number").eqNullSafe(F.lit(fx.NO_NUMBER_SOURCE))
    return df.filter(~missing), df.filter(missing)


def unit_centroids(numbered: DataFrame) -> DataFrame:
    """One row per (municipality, display, number, base): mean position and address count."""
    return numbered.groupBy("municipality", "display", "number", "base").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")
    )


def legacy_totals(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("municipality", "base").agg(F.count("*").alias("total"))


def unit_key() -> Column:
    parts = [F.col(c).cast("string") for c in ("municipality", "display", "number", "base")]
    return F.concat_ws("\u0001", *parts)


def in_merge_zone(merge_zones: list[tuple[str, str]] | None) -> Column:
    """Zones in which close units are one place. ``None`` means every zone."""
    if merge_zones is None:
        return F.lit(True)
    inside = F.lit(False)
    for muni, display in merge_zones:
        inside = inside | (
            (F.col("municipality").cast("string") == muni) & (F.col("display") == display)
        )
    return inside


def close_pairs(
    units: DataFrame,
    merge_zones: list[tuple[str, str]] | None = fx.DISTANCE_MERGE_ZONES,
    metres: float = fx.MERGE_DISTANCE_METRES,
) -> DataFrame:
    """(a, b, dist_m): units of one (municipality, display, number) within ``metres``, a < b.

    A unit meets only units of its own cell and the neighbouring ones. Use ``close_links`` where
    only connectivity matters: it links the same clusters with far fewer rows.
    """
    keys = ["municipality", "display", "number", "cx", "cy"]
    placed = _placed(units, merge_zones)
    home = placed.withColumns(
        {"cx": F.floor(F.col("x") / metres), "cy": F.floor(F.col("y") / metres)}
    )
    around = home.withColumns(
        {
            "cx": F.explode(F.array(*[F.col("cx") + d for d in (-1, 0, 1)])),
        }
    ).withColumn("cy", F.explode(F.array(*[F.col("cy") + d for d in (-1, 0, 1)])))
    left = home.select(*keys, F.col("unit").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    right = around.select(*keys, F.col("unit").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dist = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return (
        left.join(right, keys)
        .filter((F.col("a") < F.col("b")) & (dist <= metres))
        .select("a", "b", dist.alias("dist_m"))
    )


def _placed(units: DataFrame, merge_zones) -> DataFrame:
    return units.filter(in_merge_zone(merge_zones)).select(
        "municipality", "display", "number", unit_key().alias("unit"), "x", "y"
    )


def close_links(
    units: DataFrame,
    merge_zones: list[tuple[str, str]] | None = fx.DISTANCE_MERGE_ZONES,
    metres: float = fx.MERGE_DISTANCE_METRES,
    levels: int = 2,
) -> DataFrame:
    """(a, b): links with the same connected components as ``close_pairs``.

    Cells have a diagonal of ``metres``, so a cell is one cluster: its units are linked to the
    cell's first one, without pairs. Cells within reach are compared by the boxes around their
    units: surely near -> one link, surely apart -> nothing, unclear -> compare their 8 x 8
    parts, ``levels`` times, and at last the distinct points of parts that are still unclear.
    """
    group = ["municipality", "display", "number"]
    step = metres / math.sqrt(2.0) / 8**levels
    units = _placed(units, merge_zones).withColumns(
        {"fine_x": F.floor(F.col("x") / step), "fine_y": F.floor(F.col("y") / step)}
    )

    def grid(level: int) -> Column:
        size = 8 ** (levels - level)
        return F.struct(
            F.floor(F.col("fine_x") / size).alias("x"), F.floor(F.col("fine_y") / size).alias("y")
        )

    def boxes(parent: Column, cell: Column, side: str) -> DataFrame:
        """Boxes of the children of a cell: (group, <side>_parent, <side>)."""
        return (
            units.groupBy(*group, parent.alias(f"{side}_parent"), cell.alias("cell"))
            .agg(
                F.min("x").alias("x0"),
                F.max("x").alias("x1"),
                F.min("y").alias("y0"),
                F.max("y").alias("y1"),
                F.min("unit").alias("rep"),
            )
            .select(
                *group,
                f"{side}_parent",
                F.struct("cell", "x0", "x1", "y0", "y1", "rep").alias(side),
            )
        )

    def span(axis: str, low: str, high: str) -> Column:
        return F.greatest(
            F.col(f"l.{axis}{high}") - F.col(f"r.{axis}{low}"),
            F.col(f"r.{axis}{high}") - F.col(f"l.{axis}{low}"),
        )

    most = F.hypot(span("x", "0", "1"), span("y", "0", "1"))
    least = F.hypot(
        F.greatest(F.lit(0.0), span("x", "1", "0")), F.greatest(F.lit(0.0), span("y", "1", "0"))
    )

    # each pair of cells in the 5 x 5 surroundings once
    offsets = [(dx, dy) for dx in range(3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    around = F.explode(
        F.array(
            *[
                F.struct(
                    (F.col("l.cell.x") + dx).alias("x"), (F.col("l.cell.y") + dy).alias("y")
                )
                for dx, dy in offsets
            ]
        )
    )
    cells = boxes(grid(0), grid(0), "l").drop("l_parent")
    stars = units.withColumn("cell", grid(0)).join(
        cells.select(*group, F.col("l.cell").alias("cell"), F.col("l.rep").alias("b")),
        [*group, "cell"],
    )
    pairs = cells.withColumn("r_parent", around).join(
        boxes(grid(0), grid(0), "r"), [*group, "r_parent"]
    )
    links = stars.select(F.col("unit").alias("a"), "b")
    for level in range(1, levels + 3):
        # written, as both the links and the next level read it; mostly nothing is unclear
        judged = pairs.select(*group, "l", "r", most.alias("most"), least.alias("least"))
        judged = cut(judged.filter(F.col("least") <= metres), "boxes")
        near = judged.filter(F.col("most") <= metres)
        links = links.unionByName(near.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")))
        unclear = judged.filter(F.col("most") > metres)
        if unclear.isEmpty():
            break
        child = grid(level) if level <= levels else F.struct("x", "y")
        unclear = unclear.select(
            *group, F.col("l.cell").alias("l_parent"), F.col("r.cell").alias("r_parent")
        )
        pairs = unclear.join(boxes(grid(level - 1), child, "l"), [*group, "l_parent"]).join(
            boxes(grid(level - 1), child, "r"), [*group, "r_parent"]
        )
    return links.filter("a <> b").distinct()


def merge_clusters(units: DataFrame, clusters: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per cluster: position weighted by address count, id base of its largest zone.

    clusters(vertex, comp) as from ``connected_components``; units outside it stay alone.
    """
    keyed = units.withColumn("unit", unit_key())
    joined = (
        keyed.join(clusters.withColumnRenamed("vertex", "unit"), "unit", "left")
        .withColumn("comp", F.coalesce("comp", "unit"))
        .join(totals, ["municipality", "base"])
    )
    weight = F.sum("n")
    return joined.groupBy("municipality", "display", "number", "comp").agg(
        (F.sum(F.col("x") * F.col("n")) / weight).alias("x"),
        (F.sum(F.col("y") * F.col("n")) / weight).alias("y"),
        F.min_by("base", F.struct(-F.col("total"), "base")).alias("base"),
        weight.alias("n"),
    )


def clustered_units(
    units: DataFrame,
    totals: DataFrame,
    merge_zones: list[tuple[str, str]] | None = fx.DISTANCE_MERGE_ZONES,
) -> DataFrame:
    """Clusters of the merge zones and all other units as they are."""
    inside = in_merge_zone(merge_zones)
    merging = units.filter(inside)
    clusters = connected_components(
        close_links(merging, None), merging.select(unit_key().alias("vertex"))
    )
    alone = units.filter(~inside).select(
        "municipality", "display", "number", unit_key().alias("comp"), "x", "y", "base", "n"
    )
    return merge_clusters(merging, clusters, totals).unionByName(alone)


def numbered_places(clusters: DataFrame) -> DataFrame:
    return _located(clusters).select(
        "municipality",
        F.concat_ws("-", "base", "number").alias("id"),
        F.concat_ws(", ", "display", "number").alias("name"),
        F.col("display").alias("partida"),
        F.col("number").alias("num"),
        "lat",
        "lng",
        F.lit(None).cast("string").alias("ref"),
    )


def _located(df: DataFrame) -> DataFrame:
    return df.withColumn("p", geo.utm_to_wgs84("x", "y")).withColumns(
        {"lat": geo.round_coord("p.lat"), "lng": geo.round_coord("p.lng")}
    )


def sn_places(records: DataFrame, grid_m: float = fx.SN_DEDUP_METRES) -> DataFrame:
    """Places without a number, one per occupied grid cell of a zone.

    records(municipality, display, base, x, y, ref). The id carries the cell only where one
    base id has several cells; those are found with a count that is joined back, so a common
    base id never has to fit in one window.
    """
    cells = records.groupBy(
        "municipality",
        "base",
        F.rint(F.col("x") / grid_m).cast("bigint").alias("gx"),
        F.rint(F.col("y") / grid_m).cast("bigint").alias("gy"),
    ).agg(
        F.avg("x").alias("x"),
        F.avg("y").alias("y"),
        F.min("ref").alias("ref"),
        F.min("display").alias("display"),
    )
    has_ref = F.col("ref") != ""
    cells = cells.withColumn(
        "base_id",
        F.when(has_ref, F.concat(F.col("base"), F.lit("-sn-"), text.slugify("ref"))).otherwise(
            F.concat(F.col("base"), F.lit("-sn"))
        ),
    )
    repeated = (
        cells.groupBy("municipality", "base_id").agg(F.count("*").alias("n")).filter("n > 1")
    )
    joined = cells.join(repeated, ["municipality", "base_id"], "left")
    number = fx.NO_NUMBER_DISPLAY
    return _located(joined).select(
        "municipality",
        F.when(F.col("n").isNull(), F.col("base_id"))
        .otherwise(F.concat_ws("-", "base_id", "gx", "gy"))
        .alias("id"),
        F.concat(F.col("display"), F.lit(f", {number}")).alias("name"),
        F.col("display").alias("partida"),
        F.lit(number).alias("num"),
        "lat",
        "lng",
        text.parcel_ref_label("ref").alias("ref"),
    )


def all_places(numbered: DataFrame, sn: DataFrame) -> DataFrame:
    return numbered.unionByName(sn, allowMissingColumns=True)


def published_order(places: DataFrame) -> DataFrame:
    """(partida, num) by code point, as published; id breaks ties."""
    return places.orderBy("municipality", "partida", "num", "id")


def build_places(
    addresses: DataFrame,
    merge_zones: list[tuple[str, str]] | None = fx.DISTANCE_MERGE_ZONES,
) -> DataFrame:
    """addresses(municipality, raw_name, number, x, y, local_id) -> places."""
    numbered, without = split_numbered(cut(rural_addresses(addresses), "rural"))
    units = cut(unit_centroids(numbered), "units")
    totals = units.groupBy("municipality", "base").agg(F.sum("n").alias("total"))
    units = clustered_units(units, totals, merge_zones)
    sn = sn_places(without.withColumn("ref", text.parcel_ref("local_id")))
    return all_places(numbered_places(units), sn)


def build_report(addresses: DataFrame, places: DataFrame) -> DataFrame:
    """(metric, n): rows read, rows kept in total and per type, partidas, final places."""
    rural = rural_addresses(addresses)
    numbered, without = split_numbered(rural)
    parts = [
        _metric(addresses, F.lit("addresses_read"), F.count("*")),
        _metric(numbered, F.lit("kept_numbered"), F.count("*")),
        _metric(without, F.lit("kept_without_number"), F.count("*")),
        numbered.groupBy(F.concat(F.lit("type_"), F.col("code")).alias("metric")).agg(
            F.count("*").alias("n")
        ),
        _metric(numbered.select("municipality", "display").distinct(), F.lit("partidas"), F.count("*")),
        _metric(places, F.lit("places"), F.count("*")),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def _metric(df: DataFrame, name: Column, value: Column) -> DataFrame:
    return df.agg(value.alias("n")).select(name.alias("metric"), "n")


def zone_density(addresses: DataFrame, cell_m: float = 100.0) -> DataFrame:
    """Dwellings per hectare of each zone; its area is the occupied cells of one hectare."""
    cells = addresses.groupBy(
        "municipality",
        "zone",
        F.floor(F.col("x") / cell_m).alias("cx"),
        F.floor(F.col("y") / cell_m).alias("cy"),
    ).agg(F.count("*").alias("dwellings"))
    hectares = F.count("*") * (cell_m * cell_m / 10000.0)
    return cells.groupBy("municipality", "zone").agg(
        F.sum("dwellings").alias("dwellings"),
        hectares.alias("hectares"),
        (F.sum("dwellings") / hectares).alias("density"),
    )


def check_srs(addresses: DataFrame, expected: str = fx.EXPECTED_SRS) -> DataFrame:
    """Rows whose reference system is not the expected one. Empty means safe to go on."""
    return addresses.filter(~F.col("srs").eqNullSafe(F.lit(expected)))


def require_srs(addresses: DataFrame, expected: str = fx.EXPECTED_SRS) -> DataFrame:
    """The same rows; the job fails on any row in another reference system."""
    message = F.concat(F.lit("unexpected srsName: "), F.coalesce("srs", F.lit("none")))
    good = F.col("srs").eqNullSafe(F.lit(expected))
    return addresses.withColumn("srs", F.when(good, F.col("srs")).otherwise(F.raise_error(message)))
