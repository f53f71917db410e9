"""Sources and sinks: whole tables are written in the external formats and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.operators import addresses as ad
from sendero.operators import roads
from sendero.plans.session import cut, scratch
from sendero.sources import backup, gml, graph, osm, towns

from . import inputs as inp
from .functions import ADDRESSES, PLACES, registry
from .inputs import Tables, duck
from .roads import EDGES, NODES, RESTRICTIONS, VERTICES, edges, nodes, osm_nodes, restrictions, ways

QUERIES, ORACLES, query = registry()

SRS = "urn:ogc:def:crs:EPSG::25830"


def gml_text(t: Tables) -> str:
    """Addresses and thoroughfare names in one GML text per row."""
    escaped = F.replace(F.col("raw_name"), F.lit("&"), F.lit("&amp;"))
    address = F.format_string(
        '<AD:Address gml:id="A%s"><AD:inspireId><base:Identifier><base:localId>%s</base:localId></base:Identifier></AD:inspireId>'
        '<AD:position><AD:GeographicPosition><AD:geometry><gml:Point gml:id="P%s" srsName="' + SRS + '"><gml:pos>%s %s</gml:pos></gml:Point></AD:geometry>'
        "</AD:GeographicPosition></AD:position><AD:locator><AD:AddressLocator><AD:designator><AD:LocatorDesignator><AD:designator>%s</AD:designator>"
        "<AD:type/></AD:LocatorDesignator></AD:designator></AD:AddressLocator></AD:locator>"
        '<AD:component xlink:href="#U%s"/><AD:component xlink:href="#T%s"/></AD:Address>',
        F.col("addr_id"), F.col("local_id"), F.col("addr_id"), F.col("x").cast("string"), F.col("y").cast("string"), F.col("number"), F.col("addr_id"), F.col("addr_id"),
    )
    name = F.format_string(
        '<AD:ThoroughfareName gml:id="T%s"><AD:name><AD:ThoroughfareNameValue><AD:name><GN:GeographicalName><GN:spelling><GN:SpellingOfName><GN:text>%s</GN:text>'
        "</GN:SpellingOfName></GN:spelling></GN:GeographicalName></AD:name></AD:ThoroughfareNameValue></AD:name></AD:ThoroughfareName>",
        F.col("addr_id"), escaped,
    )
    rows = t(inp.ADDRESSES).select(F.floor(F.col("addr_id") / 1000).alias("file"), F.concat(address, name).alias("xml"))
    root = '<gml:FeatureCollection xmlns:gml="g" xmlns:AD="a" xmlns:GN="n" xmlns:base="b" xmlns:xlink="x">'
    files = rows.groupBy("file").agg(F.array_join(F.collect_list("xml"), "\n").alias("xml"))
    folder = scratch(t.spark, "gml")
    documents = files.select("file", F.concat(F.lit(root), "xml", F.lit("</gml:FeatureCollection>")).alias("value"))
    documents.write.partitionBy("file").option("maxRecordsPerFile", 1).text(folder)
    return f"{folder}/*"


@query("s01_gml_addresses", f"SELECT 'A' || addr_id AS addr_id, number, x, y, local_id, '{SRS}' AS srs, 'U' || addr_id || ' T' || addr_id AS tn_refs FROM ({ADDRESSES})")
def s01(t):
    rows = ad.require_srs(gml.read_gml_addresses(t.spark, gml_text(t)))
    return rows.select("addr_id", "number", "x", "y", "local_id", "srs", F.array_join("tn_refs", " ").alias("tn_refs"))


@query("s02_gml_thoroughfares", f"SELECT 'T' || addr_id AS gml_id, raw_name AS name FROM ({ADDRESSES})")
def s02(t):
    return gml.read_gml_thoroughfares(t.spark, gml_text(t)).select("gml_id", "name")


def headers(t: Tables) -> DataFrame:
    return t("SELECT DISTINCT p_type AS id, upper(p_type) AS name, 'cadastre' AS source, '2026-02-20' AS sourceDate, 3 AS version FROM {part}")


@query("s03_town_documents", f"SELECT town, CAST(3 AS INTEGER) AS version, id, name, partida, num, lat, lng, ref FROM ({PLACES})")
def s03(t):
    folder = scratch(t.spark, "towns")
    towns.write_town_documents(t(inp.PLACES), headers(t), folder)
    return towns.read_towns(t.spark, f"{folder}/*").select("town", "version", "id", "name", "partida", "num", "lat", "lng", "ref")


@query("s09_written_towns", f"SELECT p.town, id, num, count(*) OVER (PARTITION BY p.town) AS town_count FROM ({PLACES}) p")
def s09(t):
    folder = scratch(t.spark, "towns")
    towns.write_towns(t(inp.PLACES), headers(t), folder)
    places, heads = towns.read_written_towns(t.spark, folder)
    counts = heads.select(F.col("id").alias("town"), F.col("count").cast("bigint").alias("town_count"))
    return places.join(counts, "town").select("town", "id", "num", "town_count")


@query("s04_s10_manifest", "SELECT p_type AS id, CAST(max(p_size) AS INTEGER) AS version, CAST(count(*) AS INTEGER) AS count, 'graph' AS artifact FROM part GROUP BY 1")
def s04(t):
    path = scratch(t.spark, "manifest")
    none, no_artifacts = towns.read_manifest(t.spark, path + "/missing")
    entries = t("SELECT p_type AS id, upper(p_type) AS name, concat(p_type, '.json') AS file, CAST(max(p_size) AS INT) AS version, CAST(count(*) AS INT) AS count, '2026' AS sourceDate FROM {part} GROUP BY p_type")
    shared = entries.agg(F.lit("graph").alias("name"), F.lit("g.json").alias("file"), F.max("version").alias("version"), F.sum("count").alias("size"))
    towns.write_manifest(none, shared.unionByName(no_artifacts), entries, path)
    listed, artifacts = towns.read_manifest(t.spark, path)
    return listed.join(artifacts.select(F.col("name").alias("artifact"))).select("id", "version", "count", "artifact")


@query("s05_w09_osm_ways", f"SELECT g.way_id AS id, highway, CAST(n AS INTEGER) AS vertices, round(s, 4) AS lat_sum FROM ({duck(inp.WAY_TAGS)}) g JOIN (SELECT way_id, count(*) AS n, sum(lat) AS s FROM ({VERTICES}) GROUP BY 1) USING (way_id)")
def s05(t):
    rows = osm.read_osm_ways(t.spark, lines_as_tiles(ways(t), "way"))
    total = F.aggregate("geometry", F.lit(0.0), lambda acc, p: acc + p["lat"])
    return rows.select("id", F.element_at("tags", F.lit("highway")).alias("highway"), F.size("geometry").alias("vertices"), F.round(total, 4).alias("lat_sum"))


def lines_as_tiles(elements: DataFrame, kind: str) -> str:
    """Tiles of up to a thousand ids as {"elements": [...]}; tile b repeats tile a with the real tags."""
    folder = scratch(elements.sparkSession, "osm")
    typed = cut(elements.select(F.lit(kind).alias("type"), "*"), "elements")
    older = typed.withColumn("tags", F.create_map(F.lit("old"), F.lit("1"))) if "tags" in elements.columns else typed
    for name, rows in (("a", older), ("b", typed)):
        tile = F.floor(F.col("id") / 1000).alias("tile")
        answer = rows.groupBy(tile).agg(F.collect_list(F.struct(*rows.columns)).alias("elements"))
        # a tile per file, as the extract comes; not a folder each, which would have to be listed one by one
        answer.select(F.to_json(F.struct("elements")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/{name}")
    return f"{folder}/*"


@query("s06_osm_restrictions", f"SELECT rel_id AS id, restriction, via FROM ({RESTRICTIONS})")
def s06(t):
    rows = osm.read_osm_restrictions(t.spark, lines_as_tiles(restrictions(t), "relation"))
    via = F.filter("members", lambda m: m["role"] == "via")
    return rows.select("id", F.element_at("tags", F.lit("restriction")).alias("restriction"), F.element_at(via, 1)["ref"].alias("via"))


@query("s07_osm_nodes", f"SELECT node_id AS id, round(lat, 6) AS lat, round(lng, 6) AS lon FROM ({NODES})")
def s07(t):
    rows = osm.read_osm_nodes(t.spark, lines_as_tiles(osm_nodes(t), "node"))
    return rows.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("s08_s12_backup", f"SELECT 'address' AS kind, id, name, lat FROM ({duck(inp.OWN)}) UNION ALL SELECT 'edit', id, name, lat FROM ({duck(inp.INSTALLED)}) WHERE edited")
def s08(t):
    own = t(inp.OWN)
    blank = F.lit(None).cast("string")
    places = t(inp.INSTALLED).withColumns({c: blank for c in ("partida", "num", "ref", "address", "notes")} | {"updated_at": F.lit("2026")})
    path = scratch(t.spark, "backup")
    backup.write_backup(own, places, path, "sendero", 1, "2026-01-01")
    read = backup.read_backup(t.spark, path)
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "name", F.col("lat").cast("double").alias("lat"))
    return pick(read.addresses, "address").unionByName(pick(read.edits, "edit"))


@query(
    "s11_graph_tables",
    f"""SELECT (SELECT count(*) FROM ({NODES})) AS nodes, (SELECT count(*) FROM ({EDGES})) AS edges, (SELECT count(*) + count(*) FILTER (NOT oneway) FROM ({EDGES})) AS directed_edges,
    round((SELECT min(lat) FROM ({NODES})), 6) AS south, round((SELECT max(lng) FROM ({NODES})), 6) AS east, (SELECT CAST(sum(cost_cs) AS BIGINT) FROM ({EDGES})) AS total_cs, 'ODbL 1.0' AS license""",
)
def s11(t):
    folder = scratch(t.spark, "graph")
    kept = edges(t)
    bans = roads.turn_bans(restrictions(t), osm_nodes(t), nodes(t), kept)
    graph.write_graph(nodes(t), kept, bans, folder, "2026-01-01")
    _, stored, _, meta = graph.read_graph(t.spark, folder)
    return meta.join(stored.agg(F.sum("cost_cs").alias("total_cs"))).select(
        "nodes", "edges", "directed_edges", F.round("south", 6).alias("south"), F.round("east", 6).alias("east"), "total_cs", "license"
    )
