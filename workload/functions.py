"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sendero.functions import fixed_values as fx
from sendero.functions import geo, guidance, names, text
from sendero.operators import addresses, roads

from . import inputs as inp
from . import sql
from .inputs import Tables, duck, values


def registry():
    """(queries, oracles, decorator) of one module."""
    queries, oracles = {}, {}

    def query(key: str, oracle: str | None = None):
        def keep(function):
            queries[key] = lambda spark, folder: function(Tables(spark, folder))
            if oracle:
                oracles[key] = oracle
            return function

        return keep

    return queries, oracles, query


QUERIES, ORACLES, query = registry()

ADDRESSES, PLACES, FIXES = duck(inp.ADDRESSES), duck(inp.PLACES), duck(inp.FIXES)
NAMES = values(inp.RAW_NAMES, "raw, code, zone, slug")
# two fixed points of view for distances and bearings of the fixes
EVENT_PAIRS = "SELECT event_id, CAST(38.0 + (event_id % 90) * 0.001 AS DOUBLE) AS la, CAST(-0.9 + (event_id % 88) * 0.001 AS DOUBLE) AS ln, CAST(38.0 + (user_id % 70) * 0.002 AS DOUBLE) AS lb, CAST(-0.9 + value * 0.001 AS DOUBLE) AS lm FROM {events}"


@query("x01_normalize", f"SELECT doc_id, md5({sql.norm('text')}) AS norm_md5 FROM documents")
def x01(t):
    return t.table("documents").select("doc_id", F.md5(text.normalize("text")).alias("norm_md5"))


@query(
    "x02_tokenize",
    f"SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql.tokens('text')} AS toks FROM documents)",
)
def x02(t):
    toks = t.table("documents").select("doc_id", text.tokenize("text").alias("toks"))
    return toks.select("doc_id", F.size("toks").alias("n_tokens"), F.md5(F.array_join("toks", " ")).alias("tokens_md5"))


PARSED = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' ', CAST(p_size AS STRING)) WHEN 1 THEN concat(CAST(p_size AS STRING), ' ', p_brand) ELSE CAST(p_size AS STRING) END AS q FROM {part}"


@query(
    "x03_parse_query",
    f"""SELECT p_partkey, CASE WHEN has_num THEN array_to_string(toks[:-2], ' ') ELSE array_to_string(toks, ' ') END AS name_tokens,
    CASE WHEN has_num THEN toks[-1] ELSE '' END AS num_filter
    FROM (SELECT *, regexp_full_match(toks[-1], '[0-9]+') AS has_num FROM (SELECT p_partkey, {sql.tokens('q')} AS toks FROM ({duck(PARSED)})))""",
)
def x03(t):
    parsed = t(PARSED).select("p_partkey", text.parse_query("q").alias("p"))
    return parsed.select("p_partkey", F.array_join("p.name_tokens", " ").alias("name_tokens"), "p.num_filter")


@query("x04_clean_zone", f"SELECT addr_id, zone FROM ({ADDRESSES}) a JOIN {NAMES} n ON raw_name = raw WHERE code IS NOT NULL")
def x04(t):
    rows = t(inp.ADDRESSES).withColumn("code", names.rural_type("raw_name")).filter("code IS NOT NULL")
    return rows.select("addr_id", names.clean_zone("raw_name", "code").alias("zone"))


def _lookup(mapping: dict[str, str], key: str) -> str:
    cases = " ".join(f"WHEN {inp.quote(k)} THEN {inp.quote(v)}" for k, v in mapping.items())
    return f"CASE {key} {cases} END"


_MINOR = "(" + ", ".join(inp.quote(w) for w in fx.MINOR_WORDS) + ")"
# the capital of ß is SS
_CAP = lambda p: f"coalesce({_lookup(fx.PROPER_NOUN_ACCENTS, f'upper({p})')}, CASE WHEN substr({p}, 1, 1) = 'ß' THEN 'SS' ELSE upper(substr({p}, 1, 1)) END || substr({p}, 2))"
_TITLE = f"""array_to_string(list_transform(words, lambda w, i: coalesce(
  CASE WHEN length(regexp_replace(coalesce(words[i + 1], ''), '\\PL', '', 'g')) >= 3 THEN {_lookup(fx.SAINT_ABBREVIATIONS, "rtrim(upper(w), '.')")} END,
  {_lookup(fx.ABBREVIATIONS, "rtrim(upper(w), '.')")},
  CASE WHEN contains(w, '''') THEN lower(split_part(w, '''', 1)) || '''' || {_CAP("lower(substr(w, strpos(w, '''') + 1))")} END,
  CASE WHEN i > 1 AND lower(w) IN {_MINOR} THEN lower(w) END,
  array_to_string(list_transform(regexp_split_to_array(lower(w), '[-.]'), lambda p, j:
    (CASE WHEN p = '' OR (p IN {_MINOR} AND len(list_filter(regexp_split_to_array(lower(w), '[-.]')[1:j - 1], lambda x: x <> '')) > 0) THEN p ELSE {_CAP('p')} END)
    || coalesce(regexp_extract_all(w, '[-.]')[j], '')), ''))), ' ')"""


@query(
    "x05_title_case_es",
    f"SELECT doc_id, md5({_TITLE}) AS title_md5 FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS words FROM documents)",
)
def x05(t):
    return t.table("documents").select("doc_id", F.md5(names.title_case_es("text")).alias("title_md5"))


@query("x06_legacy_zone_slug", f"SELECT addr_id, slug AS base FROM ({ADDRESSES}) a JOIN {NAMES} n ON raw_name = raw WHERE code IS NOT NULL")
def x06(t):
    rows = t(inp.ADDRESSES).withColumn("code", names.rural_type("raw_name")).filter("code IS NOT NULL")
    return rows.select("addr_id", names.legacy_zone_slug("raw_name", "code").alias("base"))


@query("x07_slugify", f"SELECT doc_id, md5({sql.slug('text')}) AS slug_md5 FROM documents")
def x07(t):
    return t.table("documents").select("doc_id", F.md5(text.slugify("text")).alias("slug_md5"))


@query("x08_parcel_ref", f"SELECT addr_id, regexp_extract(local_id, '[^.]*$') AS ref FROM ({ADDRESSES})")
def x08(t):
    return t(inp.ADDRESSES).select("addr_id", text.parcel_ref("local_id").alias("ref"))


@query("x09_parcel_ref_label", f"SELECT addr_id, {sql.ref_label('ref')} AS label FROM (SELECT addr_id, regexp_extract(local_id, '[^.]*$') AS ref FROM ({ADDRESSES}))")
def x09(t):
    return t(inp.ADDRESSES).select("addr_id", text.parcel_ref_label(text.parcel_ref("local_id")).alias("label"))


@query("x10_parcel_compact", f"SELECT id, {sql.compact('ref')} AS compact FROM ({PLACES})")
def x10(t):
    return t(inp.PLACES).select("id", text.parcel_compact("ref").alias("compact"))


@query("x11_haystack", f"SELECT id, {sql.place_hay()} AS hay FROM ({PLACES})")
def x11(t):
    return t(inp.PLACES).select("id", text.place_haystack().alias("hay"))


@query("x12_utm_to_wgs84", f"SELECT addr_id, round_even(lat, 6) AS lat, round_even(lng, 6) AS lng FROM {sql.with_utm('(' + ADDRESSES + ')')}")
def x12(t):
    p = geo.utm_to_wgs84("x", "y")
    return t(inp.ADDRESSES).select("addr_id", p.alias("p")).select(
        "addr_id", geo.round_coord("p.lat").alias("lat"), geo.round_coord("p.lng").alias("lng")
    )


@query("x13_haversine", f"SELECT event_id, round({sql.haversine('la', 'ln', 'lb', 'lm')}, 3) AS dist_m FROM ({duck(EVENT_PAIRS)})")
def x13(t):
    return t(EVENT_PAIRS).select("event_id", F.round(geo.haversine_m("la", "ln", "lb", "lm"), 3).alias("dist_m"))


@query(
    "x14_bearing_and_turn",
    f"""SELECT event_id, round(b, 6) AS bearing, round(fmod(b + 360, 360), 6) AS heading, round({sql.wrap('(c - b)')}, 6) AS turn
    FROM (SELECT event_id, {sql.bearing('la', 'ln', 'lb', 'lm')} AS b, {sql.bearing('lb', 'lm', 'la', 'lm')} AS c FROM ({duck(EVENT_PAIRS)}))""",
)
def x14(t):
    rows = t(EVENT_PAIRS).select(
        "event_id",
        geo.bearing_deg("la", "ln", "lb", "lm").alias("b"),
        geo.bearing_deg("lb", "lm", "la", "lm").alias("c"),
        geo.heading_deg("la", "ln", "lb", "lm").alias("h"),
    )
    return rows.select(
        "event_id", F.round("b", 6).alias("bearing"), F.round("h", 6).alias("heading"), F.round(geo.turn_deg("b", "c"), 6).alias("turn")
    )


@query("x15_classify_turn", f"SELECT event_id, {sql.turn_kind('d')} AS kind FROM (SELECT event_id, value - 245.5 AS d FROM events)")
def x15(t):
    return t.table("events").select("event_id", geo.classify_turn(F.col("value") - 245.5).alias("kind"))


@query("x16_edge_cost", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(greatest(1, round_even(360.0 * (l_extendedprice / 100) / (l_quantity * 2), 0)) AS INTEGER) AS cost_cs FROM lineitem")
def x16(t):
    cost = geo.edge_cost_cs(F.col("l_extendedprice") / 100, F.col("l_quantity") * 2)
    return t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cost.alias("cost_cs"))


@query(
    "x17_cells",
    f"SELECT event_id, CAST(floor(lng / 0.003) AS BIGINT) AS cx, CAST(floor(lat / 0.003) AS BIGINT) AS cy FROM ({FIXES})",
)
def x17(t):
    return t(inp.FIXES).select("event_id", geo.cell("lat", "lng", fx.SNAP_CELL_DEG).alias("c")).select("event_id", "c.cx", "c.cy")


_BITS = "CAST(list_sum(list_transform(range(30), lambda b: (((y >> b::INTEGER) & 1) << (2 * b)::INTEGER) | (((x >> b::INTEGER) & 1) << (2 * b + 1)::INTEGER))) AS BIGINT)"


@query(
    "x18_morton",
    f"SELECT way_id, pos, {_BITS} AS morton FROM (SELECT way_id, pos, CAST(round_even(lat * 1000000, 0) AS BIGINT) + 200000000 AS y, CAST(round_even(lng * 1000000, 0) AS BIGINT) + 200000000 AS x FROM ({duck(inp.WAY_VERTICES)}))",
)
def x18(t):
    return t(inp.WAY_VERTICES).select("way_id", "pos", geo.morton("lat", "lng").alias("morton"))


@query("x19_segment_distance", f"SELECT event_id, round({sql.segment_dist('lb', 'ln', 'la', 'ln', 'lb', 'lm')}, 3) AS dist_m FROM ({duck(EVENT_PAIRS)})")
def x19(t):
    return t(EVENT_PAIRS).select("event_id", F.round(geo.segment_dist_m("lb", "ln", "la", "ln", "lb", "lm"), 3).alias("dist_m"))


INCOMING = duck(inp.INCOMING_ADDRESSES)


@query("x20_address_signature", f"SELECT file_pos, {sql.norm('trim(name)')} || '|' || printf('%.6f', lat) || '|' || printf('%.6f', lng) AS sig FROM ({INCOMING})")
def x20(t):
    return t(inp.INCOMING_ADDRESSES).select("file_pos", text.address_signature("name", "lat", "lng").alias("sig"))


@query(
    "x21_place_subtitle",
    f"""SELECT addr_id, coalesce(address, ref, CASE WHEN number = 'S-N' THEN 'Casa sin número · ' || municipality END, municipality || ' · Catastro') AS subtitle,
    raw_name || ' ' || number || ', ' || municipality AS default_address
    FROM (SELECT *, CASE WHEN addr_id % 5 = 0 THEN raw_name END AS address, CASE WHEN addr_id % 4 = 0 THEN {sql.ref_label("regexp_extract(local_id, '[^.]*$')")} END AS ref FROM ({ADDRESSES}))""",
)
def x21(t):
    rows = t(inp.ADDRESSES).withColumns(
        {
            "address": F.when(F.col("addr_id") % 5 == 0, F.col("raw_name")),
            "ref": F.when(F.col("addr_id") % 4 == 0, text.parcel_ref_label(text.parcel_ref("local_id"))),
        }
    )
    return rows.select(
        "addr_id",
        text.place_subtitle("address", "ref", "number", "municipality").alias("subtitle"),
        text.default_address("raw_name", "number", "municipality").alias("default_address"),
    )


@query("x22_eta", "SELECT event_id, round(value * 60 * (user_id / 200.0) * 1.4 + 10 * (event_id % 7), 3) AS eta_s FROM events")
def x22(t):
    raw = guidance.raw_eta_s(F.col("value") * 60, "user_id", F.lit(200.0))
    return t.table("events").select("event_id", F.round(guidance.eta_s(raw, F.col("event_id") % 7), 3).alias("eta_s"))


_KINDS = list(fx.MANEUVER_TEXT)
_KIND = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " ELSE 'odd' END"
LABELS = f"SELECT event_id, value * 40 AS m, value * 30 AS s, {_KIND} AS kind, CASE WHEN event_id % 3 = 0 THEN event_type END AS road FROM {{events}}"


@query(
    "x23_labels",
    f"""SELECT event_id,
    CASE WHEN m < 1000 THEN CAST(CAST(floor(m + 0.5) AS BIGINT) AS VARCHAR) || ' m'
         ELSE replace(regexp_replace(printf('%.1f', floor(m / 100 + 0.5) / 10), '\\.0$', ''), '.', ',') || ' km' END AS dist,
    CASE WHEN s < 60 THEN 'menos de 1 min' WHEN mins < 60 THEN CAST(mins AS VARCHAR) || ' min'
         WHEN mins % 60 = 0 THEN CAST(mins // 60 AS VARCHAR) || ' h' ELSE CAST(mins // 60 AS VARCHAR) || ' h ' || CAST(mins % 60 AS VARCHAR) || ' min' END AS eta,
    CASE WHEN kind IN ('straight', 'depart') AND road IS NOT NULL THEN 'Sigue por ' || road ELSE coalesce({_lookup(fx.MANEUVER_TEXT, 'kind')}, 'Continúa') END AS maneuver
    FROM (SELECT *, CAST(floor(s / 60 + 0.5) AS BIGINT) AS mins FROM ({duck(LABELS)}))""",
)
def x23(t):
    return t(LABELS).select(
        "event_id", guidance.dist_label("m").alias("dist"), guidance.eta_label("s").alias("eta"), guidance.maneuver_label("kind", "road").alias("maneuver")
    )


@query(
    "x24_tile_grid",
    f"""WITH box AS (SELECT min(lat) - 0.02 AS s, min(lng) - 0.02 AS w, max(lat) + 0.02 AS n, max(lng) + 0.02 AS e FROM ({PLACES})),
    g AS (SELECT *, greatest(1, CAST(ceil((n - s) / 0.12) AS BIGINT)) AS nr, greatest(1, CAST(ceil((e - w) / 0.12) AS BIGINT)) AS nc FROM box)
    SELECT r.i AS "row", c.j AS "col", round(s + r.i * (n - s) / nr, 6) AS south, round(w + c.j * (e - w) / nc, 6) AS west,
    round(s + (r.i + 1) * (n - s) / nr, 6) AS north, round(w + (c.j + 1) * (e - w) / nc, 6) AS east
    FROM g, LATERAL (SELECT unnest(range(nr)) AS i) r, LATERAL (SELECT unnest(range(nc)) AS j) c""",
)
def x24(t):
    tiles = roads.tile_grid(roads.bbox(t(inp.PLACES), fx.GRAPH_MARGIN_DEG))
    return tiles.select("row", "col", *[F.round(c, 6).alias(c) for c in ("south", "west", "north", "east")])


# --- predicates ------------------------------------------------------------------------------------


@query("p01_rural_type", f"SELECT addr_id, CASE WHEN split_part(raw_name, ' ', 1) IN ('PD','DS','LG','CM','VR','CR','BO','HT','PG','PL','PB','CS','AL') THEN split_part(raw_name, ' ', 1) END AS code FROM ({ADDRESSES})")
def p01(t):
    return t(inp.ADDRESSES).select("addr_id", names.rural_type("raw_name").alias("code"))


RURAL = "raw_name NOT LIKE 'CL %' AND (raw_name NOT LIKE 'PL %' OR raw_name LIKE '%DISEMIN%' OR (municipality = '03005' AND raw_name = 'PL MOS DEL BOU'))"


@query("p02_rural_pl", f"SELECT addr_id, municipality, raw_name FROM ({ADDRESSES}) WHERE {RURAL}")
def p02(t):
    return t(inp.ADDRESSES).filter(names.is_rural("raw_name", "municipality")).select("addr_id", "municipality", "raw_name")


@query("p03_split_numbered", f"SELECT addr_id, number, number <> 'S-N' AS numbered FROM ({ADDRESSES})")
def p03(t):
    numbered, without = addresses.split_numbered(t(inp.ADDRESSES))
    mark = lambda df, value: df.select("addr_id", "number", F.lit(value).alias("numbered"))
    return mark(numbered, True).unionByName(mark(without, False))


TAGS = duck(inp.WAY_TAGS)


@query(
    "p04_resolve_way",
    f"""SELECT way_id, speed, one >= 0 AS fwd, one <= 0 AS bwd FROM (SELECT way_id,
      CASE highway WHEN 'track' THEN 20 WHEN 'residential' THEN 40 WHEN 'primary' THEN 80 WHEN 'service' THEN 30 WHEN 'footway' THEN CASE WHEN motor_vehicle = 'yes' THEN 20 END END AS speed,
      CASE motor_vehicle WHEN 'yes' THEN true WHEN 'no' THEN false ELSE CASE access WHEN 'private' THEN false ELSE true END END AS allowed,
      CASE oneway WHEN 'yes' THEN 1 WHEN '-1' THEN -1 WHEN 'no' THEN 0 ELSE CASE WHEN junction = 'roundabout' THEN 1 ELSE 0 END END AS one FROM ({TAGS}))
    WHERE speed IS NOT NULL AND allowed""",
)
def p04(t):
    keys = ["highway", "motor_vehicle", "access", "oneway", "junction"]
    tags = F.map_filter(F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))]), lambda k, v: v.isNotNull())
    ways = t(inp.WAY_TAGS).select("way_id", roads.resolve_way(tags).alias("w")).filter("w IS NOT NULL")
    return ways.select("way_id", "w.speed", "w.fwd", "w.bwd")


COORDS = "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN '' WHEN o_custkey % 11 = 0 THEN '1d' WHEN o_custkey % 13 = 0 THEN 'Infinity' ELSE CAST(o_custkey % 200 - 100 AS STRING) END AS lat, CASE WHEN o_custkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE CAST(o_orderkey % 400 - 200 AS STRING) END AS lng FROM {orders}"


@query(
    "p05_valid_coords",
    f"SELECT o_orderkey, coalesce(regexp_full_match(lat, '-?[0-9]+') AND abs(TRY_CAST(lat AS DOUBLE)) <= 90 AND abs(CAST(lng AS DOUBLE)) <= 180, false) AS ok FROM ({duck(COORDS)})",
)
def p05(t):
    return t(COORDS).select("o_orderkey", geo.valid_coords("lat", "lng").alias("ok"))


@query("p07_num_prefix", f"SELECT id, num FROM ({PLACES}) WHERE num LIKE '1%'")
def p07(t):
    return t(inp.PLACES).filter(text.num_prefix("num", F.lit("1"))).select("id", "num")


@query("p08_matches_all", f"SELECT doc_id FROM documents WHERE contains({sql.norm('text')}, 'que') AND contains({sql.norm('text')}, 'the')")
def p08(t):
    wanted = F.array(F.lit("the"), F.lit("que"))
    return t.table("documents").filter(text.matches_all(text.normalize("text"), wanted)).select("doc_id")


@query("p09_low_accuracy", f"SELECT event_id, accuracy > 30 AS low FROM ({FIXES})")
def p09(t):
    return t(inp.FIXES).select("event_id", guidance.low_accuracy("accuracy").alias("low"))
