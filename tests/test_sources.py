import json

from pyspark.sql import functions as F

from sendero.operators import addresses as ad
from sendero.sources import backup, gml, graph, osm, towns
from workload.sources import lines_as_tiles

GML = """<?xml version="1.0" encoding="UTF-8"?>
<gml:FeatureCollection xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:AD="urn:a" xmlns:GN="urn:n" xmlns:base="urn:b" xmlns:xlink="http://www.w3.org/1999/xlink">
<gml:featureMember><AD:Address gml:id="A1"><AD:inspireId><base:Identifier><base:localId>03.059.1.5.ABC</base:localId></base:Identifier></AD:inspireId>
<AD:position><AD:GeographicPosition><AD:geometry><gml:Point srsName="urn:ogc:def:crs:EPSG::25830"><gml:pos>680000.5 4215000.25</gml:pos></gml:Point></AD:geometry></AD:GeographicPosition></AD:position>
<AD:locator><AD:AddressLocator><AD:designator><AD:LocatorDesignator><AD:designator></AD:designator></AD:LocatorDesignator></AD:designator>
<AD:designator><AD:LocatorDesignator><AD:designator> 12A </AD:designator></AD:LocatorDesignator></AD:designator></AD:AddressLocator></AD:locator>
<AD:component xlink:href="#U9"/><AD:component xlink:href="#T1"/></AD:Address></gml:featureMember>
<gml:featureMember><AD:Address gml:id="A2"><AD:locator><AD:AddressLocator><AD:designator><AD:LocatorDesignator><AD:designator>1</AD:designator></AD:LocatorDesignator></AD:designator></AD:AddressLocator></AD:locator></AD:Address></gml:featureMember>
<gml:featureMember><AD:Address gml:id="A3"><AD:position><AD:GeographicPosition><AD:geometry><gml:Point srsName="urn:x"><gml:pos>1 2</gml:pos></gml:Point></AD:geometry></AD:GeographicPosition></AD:position></AD:Address></gml:featureMember>
<gml:featureMember><AD:ThoroughfareName gml:id="T1"><AD:name><AD:ThoroughfareNameValue><AD:name><GN:GeographicalName><GN:spelling><GN:SpellingOfName><GN:text>PD BOCH, EL</GN:text></GN:SpellingOfName></GN:spelling></GN:GeographicalName></AD:name></AD:ThoroughfareNameValue></AD:name></AD:ThoroughfareName></gml:featureMember>
</gml:FeatureCollection>"""


def test_gml(spark, tmp_path):
    (tmp_path / "A.ES.SDGC.AD.03059.gml").write_text(GML)
    rows = gml.read_gml_addresses(spark, str(tmp_path)).collect()
    assert [(r.municipality, r.addr_id, r.tn_refs, r.number, r.x, r.y, r.local_id) for r in rows] == [
        ("03059", "A1", ["U9", "T1"], "12A", 680000.5, 4215000.25, "03.059.1.5.ABC")
    ]
    names = gml.read_gml_thoroughfares(spark, str(tmp_path))
    assert [tuple(r) for r in names.collect()] == [("03059", "T1", "PD BOCH, EL")]
    named = ad.resolve_thoroughfare(gml.read_gml_addresses(spark, str(tmp_path)), names)
    assert ad.require_srs(named).first().raw_name == "PD BOCH, EL"


PLACES = "town string, id string, name string, partida string, num string, lat double, lng double, ref string"


def test_towns_and_manifest(spark, tmp_path):
    doc = {"id": "t", "name": "T", "source": "s", "sourceDate": "2026-02-20", "version": 3, "count": 2,
           "places": [{"id": "a-1", "name": "A, 1", "partida": "A", "num": "1", "lat": 38.1, "lng": -0.9},
                      {"id": "a-sn", "name": "A, S/N", "partida": "A", "num": "S/N", "lat": 38.2, "lng": -0.8, "ref": "Ref. 1"}]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "index.json").write_text('{"towns":[{"id":"t","name":"T","file":"t.json","version":3,"count":2,"sourceDate":"x"}],"graph":{"file":"g","version":2,"size":7}}')
    rows = towns.read_towns(spark, str(tmp_path))
    assert {(r.town, r.id, r.version, r.ref) for r in rows.collect()} == {("t", "a-1", 3, None), ("t", "a-sn", 3, "Ref. 1")}
    listed, artifacts = towns.read_manifest(spark, str(tmp_path / "index.json"))
    assert listed.first().file == "t.json" and [tuple(a) for a in artifacts.collect()] == [("graph", "g", 2, 7)]
    (tmp_path / "bad.json").write_text("{not json")
    for name in ("bad.json", "missing.json"):
        listed, artifacts = towns.read_manifest(spark, str(tmp_path / name))
        assert listed.count() == 0 and artifacts.count() == 0
    head = spark.createDataFrame([("t", "T", "s", "d", 4)], "id string, name string, source string, sourceDate string, version int")
    towns.write_town_documents(rows, head, str(tmp_path / "docs"))
    text = spark.read.text(str(tmp_path / "docs" / "*")).first().value
    back = json.loads(text)
    assert back["count"] == 2 and back["places"][0] == doc["places"][0] and "ref" not in back["places"][0]
    towns.write_town_documents(rows, head, str(tmp_path / "docs2"), part_places=1)
    parts = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "docs2" / "*")).collect()]
    assert sorted((p["part"], p["places"][0]["id"], p["count"]) for p in parts) == [(0, "a-1", 1), (1, "a-sn", 1)]
    again = towns.read_towns(spark, str(tmp_path / "docs2" / "*"))
    assert {(r.town, r.id) for r in again.collect()} == {("t", "a-1"), ("t", "a-sn")}


def test_osm_later_tile_wins(spark, tmp_path):
    way = lambda v: {"type": "way", "id": 1, "tags": {"highway": v}, "geometry": [{"lat": 1.0, "lon": 2.0}]}
    (tmp_path / "tile_a.json").write_text(json.dumps([way("old"), {"type": "node", "id": 5, "lat": 1.5, "lon": 2.5}]))
    (tmp_path / "tile_b.json").write_text(json.dumps({"elements": [way("new"), {"type": "relation", "id": 9, "tags": {"restriction": "x"}, "members": [{"type": "way", "ref": 1, "role": "from"}]}]}))
    rows = osm.read_osm_ways(spark, str(tmp_path)).collect()
    assert [(r.id, r.tags, r.geometry[0].lon) for r in rows] == [(1, {"highway": "new"}, 2.0)]
    assert [tuple(r) for r in osm.read_osm_nodes(spark, str(tmp_path)).collect()] == [(5, 1.5, 2.5)]
    assert osm.read_osm_restrictions(spark, str(tmp_path)).first().members[0].role == "from"


def test_backup(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":"1","name":"Casa","lat":"38.1","lng":-0.9},{"name":5,"lat":null}]')
    (tmp_path / "b.json").write_text('{"addresses":[],"placeEdits":[{"id":"t/1","town":"t","name":"N","lat":1,"lng":2}]}')
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text('{"other":1}')
    read = backup.read_backup(spark, str(tmp_path))
    assert {r.source[-6]: r.accepted for r in read.files.collect()} == {"a": True, "b": True, "c": False, "d": False}
    assert [(r.file_pos, r.id, r.name, r.lat) for r in read.addresses.orderBy("file_pos").collect()] == [(0, "1", "Casa", "38.1"), (1, None, None, None)]
    assert [(r.town, r.id, r.lat) for r in read.edits.collect()] == [("t", "t/1", "1")]
    own = spark.createDataFrame([("1", "n", "", "", 1.0, 2.0, "c", "u")], "id string, name string, address string, notes string, lat double, lng double, created_at string, updated_at string")
    none = spark.createDataFrame([], "town string, id string, name string, partida string, num string, lat double, lng double, ref string, address string, notes string, edited boolean, updated_at string")
    doc = json.loads(backup.backup_document(own, none, "app", 1, "now").first().value)
    assert "placeEdits" not in doc and doc["addresses"][0]["createdAt"] == "c"
    two = own.unionByName(own.withColumn("id", F.lit("2")))
    edited = none.unionByName(own.select(F.lit("t").alias("town"), "id", "name", F.lit(True).alias("edited"), F.lit("u").alias("updated_at")), allowMissingColumns=True)
    backup.write_backup(two, edited, str(tmp_path / "parts"), "app", 1, "now", part_rows=1)
    read = backup.read_backup(spark, str(tmp_path / "parts"))
    assert read.files.count() == 3 and {r.id for r in read.addresses.collect()} == {"1", "2"} and read.edits.count() == 1
    backup.write_backup(own.limit(0), none, str(tmp_path / "empty"), "app", 1, "now")
    assert backup.read_backup(spark, str(tmp_path / "empty")).files.first().accepted


def test_graph_tables(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 38.0, -0.9), (1, 38.1, -0.8)], "node_id bigint, lat double, lng double")
    edges = spark.createDataFrame([(0, 0, 1, 5, False)], "edge_id bigint, a bigint, b bigint, cost_cs int, oneway boolean")
    bans = spark.createDataFrame([(0, 0, 0)], "via bigint, from_edge bigint, to_edge bigint")
    graph.write_graph(nodes, edges, bans, str(tmp_path / "g"), "2026-01-01")
    *_, meta = graph.read_graph(spark, str(tmp_path / "g"))
    row = meta.first()
    assert (row.nodes, row.edges, row.directed_edges, row.bans, row.license) == (2, 1, 2, 1, "ODbL 1.0") and row.speed_kmh["track"] == 20


def test_tiles_are_files_of_two_folders(spark):
    elements = spark.range(2500).select("id", F.lit(38.0).alias("lat"), F.lit(-0.9).alias("lon"))
    path = lines_as_tiles(elements, "node")
    tiles = spark.read.text(path).select(F.input_file_name().alias("f")).distinct()
    folders = tiles.select(F.regexp_replace("f", "/[^/]*$", "")).distinct()
    assert (tiles.count(), folders.count()) == (6, 2)  # a file for each thousand ids, none with a folder of its own
    assert osm.read_osm_nodes(spark, path).count() == 2500
