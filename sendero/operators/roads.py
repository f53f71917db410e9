"""Road network: drivable ways -> segments -> nodes, edges, turn bans."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions import geo
from ..functions.text import as_col
from ..plans.session import cut

BLOCK = 4096


# --- ways ---------------------------------------------------------------------------------------


def _in(c: Column, values: list[str]) -> Column:
    return F.coalesce(c.isin(values), F.lit(False))


def resolve_way(tags: Column | str) -> Column:
    """struct<speed, fwd, bwd> of a drivable way, null for any other."""
    tags = as_col(tags)
    tag = lambda name: F.try_element_at(tags, F.lit(name))
    speeds = F.create_map(*[F.lit(x) for pair in fx.SPEED_KMH.items() for x in pair])
    opened = _in(tag("highway"), fx.FOOT_LIKE) & _in(tag("motor_vehicle"), fx.ACCESS_POSITIVE)
    speed = F.coalesce(
        F.try_element_at(speeds, tag("highway")), F.when(opened, F.lit(fx.FOOT_LIKE_SPEED))
    )
    allowed = F.coalesce(
        *[
            F.when(_in(tag(name), fx.ACCESS_POSITIVE), True).when(
                _in(tag(name), fx.ACCESS_NEGATIVE), False
            )
            for name in fx.ACCESS_TAGS
        ],
        F.lit(True),
    )
    oneway = (
        F.when(_in(tag("oneway"), fx.ONEWAY_FORWARD), 1)
        .when(_in(tag("oneway"), fx.ONEWAY_REVERSE), -1)
        .when(_in(tag("oneway"), fx.ONEWAY_NONE), 0)
        .when(_in(tag("junction"), fx.ROUNDABOUT), 1)
        .otherwise(0)
    )
    return F.when(
        speed.isNotNull() & allowed,
        F.struct(speed.alias("speed"), (oneway >= 0).alias("fwd"), (oneway <= 0).alias("bwd")),
    )


def road_name(tags: Column | str) -> Column:
    tags = as_col(tags)
    tag = lambda name: F.nullif(F.try_element_at(tags, F.lit(name)), F.lit(""))
    return F.coalesce(tag("name"), tag("ref"))


def segments_of(geometry: Column | str) -> Column:
    """Consecutive vertex pairs of a geometry array as array<struct<pos, a, b>>."""
    geometry = as_col(geometry)
    last = F.size(geometry) - 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last))
    return F.transform(
        starts,
        lambda i: F.struct(
            i.cast("bigint").alias("pos"),
            F.element_at(geometry, i).alias("a"),
            F.element_at(geometry, i + 1).alias("b"),
        ),
    )


def segmentize(ways: DataFrame) -> DataFrame:
    """(way_id, pos, a_lat, a_lng, b_lat, b_lng, length_m, cost_cs, oneway, cls, name).

    ways(id, tags, geometry). A way that may only be driven backwards comes out reversed, so
    every one-way segment is driven from a to b. Segments without length, within one rounded
    node or with a missing end are dropped.
    """
    drivable = ways.withColumn("way", resolve_way("tags")).filter("way IS NOT NULL")
    segments = drivable.select(
        F.col("id").alias("way_id"),
        "way",
        F.element_at("tags", F.lit("highway")).alias("cls"),
        road_name("tags").alias("name"),
        F.explode(segments_of("geometry")).alias("s"),
    )
    flip = ~F.col("way.fwd")
    end = lambda mine, other, axis: F.when(flip, F.col(f"s.{other}.{axis}")).otherwise(
        F.col(f"s.{mine}.{axis}")
    )
    flat = segments.select(
        "way_id",
        F.col("s.pos").alias("pos"),
        end("a", "b", "lat").alias("a_lat"),
        end("a", "b", "lon").alias("a_lng"),
        end("b", "a", "lat").alias("b_lat"),
        end("b", "a", "lon").alias("b_lng"),
        F.col("way.speed").alias("speed"),
        (~(F.col("way.fwd") & F.col("way.bwd"))).alias("oneway"),
        "cls",
        "name",
    )
    return measured(flat)


def measured(segments: DataFrame) -> DataFrame:
    """Adds length_m and cost_cs; drops segments that join no two nodes."""
    same = (geo.micro("a_lat") == geo.micro("b_lat")) & (geo.micro("a_lng") == geo.micro("b_lng"))
    return (
        segments.withColumn("length_m", geo.haversine_m("a_lat", "a_lng", "b_lat", "b_lng"))
        .filter((F.col("length_m") > 0) & ~same)
        .withColumn("cost_cs", geo.edge_cost_cs("length_m", "speed"))
        .drop("speed")
    )


def chain_segments(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Segments of vertex rows (keys, pos, lat, lng): each vertex with the next one.

    Vertices are windowed in blocks of positions, each with the first vertex of the next block
    added, so a very long line is spread over many tasks.
    """
    home = F.floor(F.col("pos") / BLOCK)
    blocks = F.when(
        F.col("pos") % BLOCK == 0, F.array(home, home - 1)
    ).otherwise(F.array(home))
    order = W.partitionBy(*keys, "block").orderBy("pos")
    following = lambda c: F.lead(c).over(order)
    return (
        vertices.withColumn("home", home)
        .withColumn("block", F.explode(blocks))
        .withColumns(
            {"next_pos": following("pos"), "b_lat": following("lat"), "b_lng": following("lng")}
        )
        .filter((F.col("home") == F.col("block")) & (F.col("next_pos") == F.col("pos") + 1))
        .select(
            *keys, "pos", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), "b_lat", "b_lng"
        )
    )


# --- dense ids ------------------------------------------------------------------------------------


def dense_ids(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds 0, 1, 2, ... in the given order.

    A range partitioning sorts the rows over all tasks; the id is the row's place in its
    partition plus the sizes of the partitions before it. Rows with their partition number are
    written first, because the partition limits come from a sample.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = F.monotonically_increasing_id()
    placed = cut(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", local)
        .withColumn("_part", F.shiftright("_row", 33))
        .withColumn("_row", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))),
        "ids",
    )
    # one number per partition, however many rows there are
    sizes = sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts = accumulate((row["n"] for row in sizes), initial=0)
    before = df.sparkSession.createDataFrame(
        [(row["_part"], start) for row, start in zip(sizes, starts)], "_part bigint, _before bigint"
    )
    return (
        placed.join(before, "_part")
        .withColumn(name, F.col("_before") + F.col("_row"))
        .drop("_part", "_row", "_before")
    )


def morton_nodes(segments: DataFrame) -> DataFrame:
    """nodes(node_id, lat, lng, mlat, mlng, morton): rounded vertices numbered along a Z curve."""
    ends = segments.select(
        F.explode(
            F.array(
                F.struct(F.col("a_lat").alias("lat"), F.col("a_lng").alias("lng")),
                F.struct(F.col("b_lat").alias("lat"), F.col("b_lng").alias("lng")),
            )
        ).alias("p")
    ).select(geo.micro("p.lat").alias("mlat"), geo.micro("p.lng").alias("mlng"))
    nodes = ends.distinct().withColumns(
        {"lat": F.col("mlat") / fx.COORD_SCALE, "lng": F.col("mlng") / fx.COORD_SCALE}
    )
    nodes = nodes.withColumn("morton", geo.morton("lat", "lng"))
    return dense_ids(nodes, ["morton"], "node_id")


def number_edges(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(edge_id, a, b, cost_cs, oneway, cls, name, way_id), numbered in (a, b) order."""

    def at(side: str) -> DataFrame:
        return nodes.select(
            F.col("node_id").alias(side),
            F.col("mlat").alias(f"{side}_mlat"),
            F.col("mlng").alias(f"{side}_mlng"),
        )

    keyed = segments.withColumns(
        {f"{s}_m{x}": geo.micro(f"{s}_{x}") for s in "ab" for x in ("lat", "lng")}
    )
    joined = keyed.join(at("a"), ["a_mlat", "a_mlng"]).join(at("b"), ["b_mlat", "b_mlng"])
    edges = joined.select("a", "b", "cost_cs", "oneway", "cls", "name", "way_id", "pos")
    order = ["a", "b", "way_id", "pos"]
    return dense_ids(edges, order, "edge_id").drop("pos")


def morton_renumber(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the segments in their final numbering."""
    nodes = cut(morton_nodes(segments), "nodes")
    return nodes, cut(number_edges(segments, nodes), "edges")


def delta_encode(df: DataFrame, columns: list[str], key: str, block: int = BLOCK) -> DataFrame:
    """Columns as differences to the row before, in key order; each block starts absolute."""
    order = W.partitionBy("block").orderBy(key)
    out = df.withColumn("block", F.floor(F.col(key) / block))
    return out.withColumns({c: F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0)) for c in columns})


def delta_decode(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    order = W.partitionBy("block").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.sum(c).over(order) for c in columns}).drop("block")


def check_roundtrip(df: DataFrame, columns: list[str], key: str, block: int = BLOCK) -> DataFrame:
    """Rows that delta encoding does not give back. Empty means lossless."""
    back = delta_decode(delta_encode(df, columns, key, block), columns, key)
    back, df = back.select(key, *columns), df.select(key, *columns)
    return df.exceptAll(back).unionByName(back.exceptAll(df))


# --- graph tables -----------------------------------------------------------------------------------


def directed_edges(edges: DataFrame) -> DataFrame:
    """dedges(state_id, edge_id, tail, head, cost_cs): a->b always, b->a when two-way."""
    states = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("back"), F.col("a").alias("tail"), F.col("b").alias("head")),
            F.when(
                ~F.col("oneway"),
                F.struct(F.lit(1).alias("back"), F.col("b").alias("tail"), F.col("a").alias("head")),
            ),
        )
    )
    return edges.select("edge_id", "cost_cs", F.explode(states).alias("s")).select(
        (F.col("edge_id") * 2 + F.col("s.back")).alias("state_id"),
        "edge_id",
        "s.tail",
        "s.head",
        "cost_cs",
    )


def endpoints(edges: DataFrame, *keep: str) -> DataFrame:
    """One row per edge end: (edge_id, keep..., node)."""
    return edges.select("edge_id", *keep, F.explode(F.array("a", "b")).alias("node"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, out_degree): degree is undirected and counts parallel edges."""
    ends = F.explode(
        F.array(
            F.struct(F.col("a").alias("node"), F.lit(1).alias("out")),
            F.struct(F.col("b").alias("node"), (~F.col("oneway")).cast("int").alias("out")),
        )
    ).alias("e")
    return edges.select(ends).groupBy("e.node").agg(
        F.count("*").alias("degree"), F.sum("e.out").alias("out_degree")
    )


def dictionaries(edges: DataFrame) -> DataFrame:
    """(kind, value): the distinct road classes and names."""
    pairs = F.explode(
        F.array(
            F.struct(F.lit("class").alias("kind"), F.col("cls").alias("value")),
            F.struct(F.lit("name").alias("kind"), F.col("name").alias("value")),
        )
    ).alias("p")
    return edges.select(pairs).select("p.*").filter("value IS NOT NULL").distinct()


def bbox(df: DataFrame, margin: float = fx.GRAPH_MARGIN_DEG) -> DataFrame:
    """One row (south, west, north, east) around all points; fails without any point."""
    box = df.agg(
        (F.min("lat") - margin).alias("south"),
        (F.min("lng") - margin).alias("west"),
        (F.max("lat") + margin).alias("north"),
        (F.max("lng") + margin).alias("east"),
    )
    checked = F.when(F.col("south").isNull(), F.raise_error(F.lit("no coordinates found")))
    return box.withColumn("south", F.coalesce(checked.cast("double"), F.col("south")))


def tile_grid(box: DataFrame, max_deg: float = fx.MAX_TILE_DEG) -> DataFrame:
    """(row, col, south, west, north, east): equal tiles no larger than max_deg per side."""
    sides = box.withColumns(
        {
            "rows": F.greatest(F.lit(1), F.ceil((F.col("north") - F.col("south")) / max_deg)),
            "cols": F.greatest(F.lit(1), F.ceil((F.col("east") - F.col("west")) / max_deg)),
        }
    ).withColumns(
        {
            "dh": (F.col("north") - F.col("south")) / F.col("rows"),
            "dw": (F.col("east") - F.col("west")) / F.col("cols"),
        }
    )
    rows = sides.withColumn("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)))
    tiles = rows.withColumn("col", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cols") - 1)))
    south = F.col("south") + F.col("row") * F.col("dh")
    west = F.col("west") + F.col("col") * F.col("dw")
    return tiles.select(
        "row",
        "col",
        south.alias("south"),
        west.alias("west"),
        (F.col("south") + (F.col("row") + 1) * F.col("dh")).alias("north"),
        (west + F.col("dw")).alias("east"),
    )


# --- turn restrictions ---------------------------------------------------------------------------------


def _members(role: str, kind: str) -> Column:
    return F.transform(
        F.filter(
            F.coalesce("members", F.array().cast("array<struct<type:string,ref:bigint,role:string>>")),
            lambda m: (m["role"] == role) & (m["type"] == kind),
        ),
        lambda m: m["ref"],
    )


def described_restrictions(restrictions: DataFrame) -> DataFrame:
    """(rel_id, rtype, verdict, via_osm, froms, tos).

    verdict is the first reason to skip the relation, in fixed order, or null.
    """
    rtype = F.try_element_at("tags", F.lit("restriction"))
    conditional = F.exists(
        F.map_keys("tags"), lambda k: F.startswith(k, F.lit("restriction:conditional"))
    )
    excepted = F.exists(
        F.split(F.coalesce(F.try_element_at("tags", F.lit("except")), F.lit("")), ";"),
        lambda v: F.trim(v).isin(fx.EXCEPT_VEHICLES),
    )
    via_nodes, via_ways = _members("via", "node"), _members("via", "way")
    verdict = (
        F.when(rtype.isNull() & conditional, "conditional")
        .when(rtype.isNull(), "ignored")
        .when(~rtype.isin(fx.BAN_TYPES + fx.ONLY_TYPES), "unknown_type")
        .when(excepted, "excepted")
        .when((F.size(via_ways) > 0) & (F.size(via_nodes) == 0), "via_way")
        .when(F.size(via_nodes) == 0, "no_via_node")
    )
    return restrictions.withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>"))).select(
        F.col("id").alias("rel_id"),
        rtype.alias("rtype"),
        verdict.alias("verdict"),
        F.try_element_at(via_nodes, F.lit(1)).alias("via_osm"),
        _members("from", "way").alias("froms"),
        _members("to", "way").alias("tos"),
    )


def locate_via(described: DataFrame, osm_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds via: the graph node at the coordinates of the via node, null when off the graph."""
    spots = osm_nodes.select(
        F.col("id").alias("via_osm"), geo.micro("lat").alias("mlat"), geo.micro("lon").alias("mlng")
    )
    graph = nodes.select(F.col("node_id").alias("via"), "mlat", "mlng")
    found = spots.join(graph, ["mlat", "mlng"]).select("via_osm", "via")
    return described.join(found, "via_osm", "left")


def incident_edges(via_ways: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds edge_id: the edges of way_id that touch via. via_ways(via, way_id, ...)."""
    ends = endpoints(edges, "way_id").withColumnRenamed("node", "via").distinct()
    return via_ways.join(ends, ["way_id", "via"])


def _usable(located: DataFrame) -> DataFrame:
    return located.filter("verdict IS NULL AND via IS NOT NULL")


def _role_edges(located: DataFrame, edges: DataFrame, ways: str) -> DataFrame:
    listed = _usable(located).select("rel_id", "rtype", "via", F.explode(ways).alias("way_id"))
    return incident_edges(listed.distinct(), edges)


def relation_bans(located: DataFrame, edges: DataFrame) -> DataFrame:
    """(rel_id, via, from_edge, to_edge) before duplicates of different relations are removed.

    no_*: every from edge with every to edge at the via node. only_*: every from edge with all
    edges of the via node but those of the mandated way, once for each mandated way.
    """
    starts = _role_edges(located, edges, "froms").select(
        "rel_id", "rtype", "via", F.col("edge_id").alias("from_edge")
    ).distinct()
    goals = _role_edges(located, edges, "tos").select(
        "rel_id", F.col("way_id").alias("to_way"), F.col("edge_id").alias("to_edge")
    )
    only = F.col("rtype").isin(fx.ONLY_TYPES)
    direct = starts.filter(~only).join(goals.select("rel_id", "to_edge").distinct(), "rel_id")
    at_via = endpoints(edges).select(F.col("node").alias("via"), F.col("edge_id").alias("to_edge")).distinct()
    mandated = (
        starts.filter(only)
        .join(goals.select("rel_id", "to_way").distinct(), "rel_id")
        .join(at_via, "via")
        .join(goals, ["rel_id", "to_way", "to_edge"], "left_anti")
    )
    columns = ["rel_id", "via", "from_edge", "to_edge"]
    return direct.select(*columns).unionByName(mandated.select(*columns)).distinct()


def turn_bans(restrictions: DataFrame, osm_nodes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """bans(via, from_edge, to_edge) without duplicates."""
    located = locate_via(described_restrictions(restrictions), osm_nodes, nodes)
    return relation_bans(located, edges).select("via", "from_edge", "to_edge").distinct()


def restriction_report(located: DataFrame, edges: DataFrame) -> DataFrame:
    """(reason, n): relations read, kept and skipped by reason, ban rows, interior via ways."""
    bans = relation_bans(located, edges)
    kept = bans.select("rel_id").distinct().withColumn("kept", F.lit(True))
    pairs = _usable(located).select("rel_id", "via", "froms", "tos")
    ends = {}
    for role in ("froms", "tos"):
        asked = pairs.select("rel_id", "via", F.posexplode(role).alias("pos", "way_id"))
        found = (
            incident_edges(asked.select("via", "way_id").distinct(), edges)
            .groupBy("via", "way_id")
            .agg(F.count("*").alias("found"))
        )
        joined = asked.join(found, ["via", "way_id"], "left")
        ends[role] = joined.groupBy("rel_id").agg(
            F.count("found").alias(f"{role}_ok"),
            F.count_if(F.col("found").isNull()).alias(f"{role}_off"),
            F.count_if(F.col("found") > 1).alias(f"{role}_inner"),
        )
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    off = (number("froms_off") > 0) | ((number("froms_ok") > 0) & (number("tos_off") > 0))
    judged = (
        located.join(kept, "rel_id", "left")
        .join(ends["froms"], "rel_id", "left")
        .join(ends["tos"], "rel_id", "left")
    )
    reason = (
        F.when(F.col("verdict").isNotNull(), F.col("verdict"))
        .when(F.col("via").isNull(), "via_off_graph")
        .when(F.col("kept"), "kept_relations")
        .when(off, "edge_off_graph")
        .otherwise("ignored")
    )
    judged = judged.withColumn("reason", reason)
    counts = judged.filter("reason <> 'ignored'").groupBy("reason").agg(F.count("*").alias("n"))
    inner = number("froms_inner") + number("froms_ok") * number("tos_inner")
    total = judged.agg(F.count("*").alias("relations"), F.sum(inner).alias("interior_via")).unpivot(
        [], ["relations", "interior_via"], "reason", "n"
    )
    rows = bans.select("via", "from_edge", "to_edge").distinct().agg(F.count("*").alias("n"))
    return counts.unionByName(total).unionByName(rows.select(F.lit("kept_rows").alias("reason"), "n"))


def check_bans(bans: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, violations): ids in range, both edges at the via node, no duplicates."""
    known = bans.join(nodes.select(F.col("node_id").alias("via")), "via", "left_anti")
    ends = endpoints(edges).select(F.col("edge_id"), F.col("node").alias("via"))
    loose = [
        bans.join(ends.withColumnRenamed("edge_id", side), ["via", side], "left_anti")
        for side in ("from_edge", "to_edge")
    ]
    repeated = bans.groupBy("via", "from_edge", "to_edge").agg((F.count("*") - 1).alias("extra"))
    named = lambda df, name, value: df.agg(value.alias("violations")).select(F.lit(name).alias("check"), "violations")
    zero = F.lit(0).cast("bigint")
    return (
        named(known, "unknown_via", F.count("*"))
        .unionByName(named(loose[0], "from_not_at_via", F.count("*")))
        .unionByName(named(loose[1], "to_not_at_via", F.count("*")))
        .unionByName(named(repeated, "duplicates", F.coalesce(F.sum("extra"), zero)))
    )


# --- turns -------------------------------------------------------------------------------------------


def with_bearing(dedges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds the bearing of every directed edge."""
    at = lambda end: nodes.select(
        F.col("node_id").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("lng").alias(f"{end}_lng")
    )
    return (
        dedges.join(at("tail"), "tail")
        .join(at("head"), "head")
        .withColumn("bearing", geo.bearing_deg("tail_lat", "tail_lng", "head_lat", "head_lng"))
        .drop("tail_lat", "tail_lng", "head_lat", "head_lng")
    )


def turn_graph(
    dedges: DataFrame,
    nodes: DataFrame,
    bans: DataFrame,
    reversal_cs: int = fx.REVERSAL_PENALTY_CS,
    reversal_deg: float = fx.REVERSAL_MIN_DEG,
) -> DataFrame:
    """(p, q, via, cost_cs): directed edge q may follow p, at q's cost plus a reversal penalty.

    One row per pair of edges that meet: the movements of a junction, of which a road network
    has a handful. Bans are removed.
    """
    aimed = with_bearing(dedges, nodes)
    left = aimed.select(
        F.col("state_id").alias("p"),
        F.col("edge_id").alias("from_edge"),
        F.col("head").alias("via"),
        F.col("bearing").alias("p_bearing"),
    )
    right = aimed.select(
        F.col("state_id").alias("q"),
        F.col("edge_id").alias("to_edge"),
        F.col("tail").alias("via"),
        F.col("bearing").alias("q_bearing"),
        "cost_cs",
    )
    turn = F.abs(geo.turn_deg("p_bearing", "q_bearing"))
    return (
        left.join(right, "via")
        .join(bans.select("via", "from_edge", "to_edge"), ["via", "from_edge", "to_edge"], "left_anti")
        .select(
            "p",
            "q",
            "via",
            (F.col("cost_cs") + F.when(turn >= reversal_deg, reversal_cs).otherwise(0))
            .cast("bigint")
            .alias("cost_cs"),
        )
    )
