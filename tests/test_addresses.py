import itertools
import random

from pyspark.sql import functions as F

from sendero.operators import addresses as ad
from sendero.operators.components import component_sizes, connected_components

MERGE = "San Antonio de la Florida"


def clusters_by_hand(points, metres=150.0):
    """Single-link clusters by brute force."""
    groups = [{p[0]} for p in points]
    pos = {p[0]: p[1:] for p in points}
    merged = True
    while merged:
        merged = False
        for a, b in itertools.combinations(groups, 2):
            if any(((pos[i][0] - pos[j][0]) ** 2 + (pos[i][1] - pos[j][1]) ** 2) ** 0.5 <= metres for i in a for j in b):
                groups.remove(a), groups.remove(b), groups.append(a | b)
                merged = True
                break
    return sorted(sorted(g) for g in groups)


def units_frame(spark, points):
    rows = [("03059", MERGE, "5", base, float(x), float(y), 1) for base, x, y in points]
    return spark.createDataFrame(
        rows, "municipality string, display string, number string, base string, x double, y double, n bigint"
    )


def test_close_links_give_single_link_clusters(spark):
    rng = random.Random(7)
    points = [(f"b{i:03d}", 680000 + rng.random() * 1500, 4215000 + rng.random() * 1500) for i in range(70)]
    points += [("edge-a", 690000.0, 4215000.0), ("edge-b", 690150.0, 4215000.0), ("edge-c", 690300.001, 4215000.0)]
    units = units_frame(spark, points)
    vertices = units.select(ad.unit_key().alias("vertex"))
    want = clusters_by_hand(points)
    for links in (ad.close_links(units), ad.close_pairs(units)):
        comps = connected_components(links, vertices).collect()
        got = {}
        for row in comps:
            got.setdefault(row.comp, []).append(row.vertex.split("\u0001")[-1])
        assert sorted(sorted(g) for g in got.values()) == want


def test_components_of_a_long_chain_and_islands(spark):
    pairs = spark.range(300).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(900, 800), (901, 800)]))
    vertices = spark.range(301).toDF("vertex").union(spark.createDataFrame([(800,), (900,), (901,), (999,)]))
    comps = connected_components(pairs, vertices)
    assert {(r.comp, r.n) for r in comps.groupBy("comp").agg(F.count("*").alias("n")).collect()} == {(0, 301), (800, 3), (999, 1)}
    top = component_sizes(comps).filter("largest").collect()
    assert [(r.comp, r.n) for r in top] == [(0, 301)]


def test_merge_zone_fixture(spark):
    points = [("s-antonio", 0, 0), ("san-antonio", 100, 0), ("s-antonio-b", 240, 0), ("far", 600, 0)]
    units = units_frame(spark, points)
    totals = spark.createDataFrame(
        [("03059", "s-antonio", 5), ("03059", "san-antonio", 9), ("03059", "s-antonio-b", 9), ("03059", "far", 1)],
        "municipality string, base string, total bigint",
    )
    got = ad.clustered_units(units, totals).orderBy("x").collect()
    assert [(r.base, r.n) for r in got] == [("s-antonio-b", 3), ("far", 1)]
    assert abs(got[0].x - (0 + 100 + 240) / 3) < 1e-9


def test_sn_fixture(spark):
    rows = [
        ("03005", "Zona", "zona", 100.1, 50.0, "B"),
        ("03005", "Zona", "zona", 99.9, 50.0, "A"),
        ("03005", "Otra", "otra", 10.0, 10.0, "R1"),
        ("03005", "Otra", "otra", 20.0, 10.0, "R1"),
        ("03005", "Nada", "nada", 20.0, 10.0, ""),
    ]
    df = spark.createDataFrame(rows, "municipality string, display string, base string, x double, y double, ref string")
    got = {r.id: r for r in ad.sn_places(df).collect()}
    assert set(got) == {"zona-sn-a", "otra-sn-r1-10-10", "otra-sn-r1-20-10", "nada-sn"}
    assert got["zona-sn-a"].ref == "Ref. A" and got["nada-sn"].ref is None


def test_resolve_thoroughfare_takes_first_known_reference(spark):
    addresses = spark.createDataFrame(
        [(1, "m", ["x", "b", "a"], 5), (2, "m", ["x"], 6), (3, "m", ["a", "b"], 7), (4, "n", ["a"], 8)],
        "addr_id bigint, municipality string, tn_refs array<string>, extra int",
    )
    tn = spark.createDataFrame([("m", "a", "A"), ("m", "b", "B")], "municipality string, gml_id string, name string")
    got = {(r.addr_id, r.raw_name, r.extra) for r in ad.resolve_thoroughfare(addresses, tn).collect()}
    assert got == {(1, "B", 5), (3, "A", 7)}


def test_canonical_names_and_density(spark):
    df = spark.createDataFrame([("03005", "Huerta la 17"), ("03099", "Huerta la 17")], "municipality string, zone string")
    got = {r.municipality: r.display for r in ad.with_canonical_zone(df, ad.canonical_zones(df)).collect()}
    assert got == {"03005": "La Huerta", "03099": "Huerta la 17"}
    pts = spark.createDataFrame([("m", "z", 0.0, 0.0), ("m", "z", 50.0, 0.0), ("m", "z", 150.0, 0.0)], "municipality string, zone string, x double, y double")
    row = ad.zone_density(pts).first()
    assert (row.dwellings, row.hectares, row.density) == (3, 2.0, 1.5)


def test_build_places_end_to_end(spark):
    rows = [
        ("03005", "PD MOCO EL GP.3", "5", 680000.0, 4215000.0, "a.b"),
        ("03005", "PD MOCO EL GP.3", "5", 680010.0, 4215000.0, "a.b"),
        ("03005", "PD MOCO EL GP.4", "5", 680020.0, 4215000.0, "a.b"),
        ("03005", "CL MAYOR", "5", 680020.0, 4215000.0, "a.b"),
        ("03005", "PD BOCH, EL", "S-N", 680020.0, 4215000.0, "03.059.179.S-N.03059A02000295"),
    ]
    df = spark.createDataFrame(rows, "municipality string, raw_name string, number string, x double, y double, local_id string")
    got = {r.id: r for r in ad.build_places(df).collect()}
    assert set(got) == {"moco-el-gp-3-5", "moco-el-gp-4-5", "el-boch-sn-03059a02000295"}
    assert got["moco-el-gp-3-5"].name == "El Moco, 5"
    assert got["el-boch-sn-03059a02000295"].ref == "Políg. 20 · Parc. 295"
    assert 38.0 < got["moco-el-gp-3-5"].lat < 38.1 and -1.0 < got["moco-el-gp-3-5"].lng < -0.9


def test_srs_guard(spark):
    df = spark.createDataFrame([("urn:ogc:def:crs:EPSG::25830",), ("urn:x",), (None,)], "srs string")
    assert ad.check_srs(df).count() == 2
    try:
        ad.require_srs(df).collect()
        raise AssertionError("no error")
    except Exception as error:
        assert "unexpected srsName" in str(error)
