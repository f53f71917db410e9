"""Address ETL over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sendero.functions import fixed_values as fx
from sendero.functions import text
from sendero.operators import addresses as ad
from sendero.operators import components, search
from sendero.plans.session import cut

from . import inputs as inp
from . import sql
from .functions import ADDRESSES, NAMES, RURAL, registry
from .inputs import Tables, duck, values

QUERIES, ORACLES, query = registry()

CANON = values(fx.CANONICAL_ZONE_NAMES, "c_muni, c_zone, canonical")
RURAL_SQL = f"""(SELECT addr_id, municipality, raw_name, number, x, y, code, zone, coalesce(canonical, zone) AS display, slug AS base,
  regexp_extract(local_id, '[^.]*$') AS ref
  FROM ({ADDRESSES}) a JOIN {NAMES} n ON raw_name = raw LEFT JOIN {CANON} c ON municipality = c_muni AND zone = c_zone WHERE {RURAL})"""
UNITS_SQL = f"""(SELECT municipality, display, number, base, avg(x) AS x, avg(y) AS y, count(*) AS n FROM {RURAL_SQL} WHERE number <> 'S-N' GROUP BY ALL)"""
TOTALS_SQL = f"(SELECT municipality, base, count(*) AS total FROM {RURAL_SQL} WHERE number <> 'S-N' GROUP BY ALL)"
KEY = "concat_ws(chr(1), municipality, display, number, base)"
PAIRS_SQL = f"""(SELECT a.unit AS a, b.unit AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist_m
  FROM (SELECT *, {KEY} AS unit FROM {UNITS_SQL}) a JOIN (SELECT *, {KEY} AS unit FROM {UNITS_SQL}) b USING (municipality, display, number)
  WHERE a.unit < b.unit AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 150)"""
MERGE = "municipality = '03059' AND display = 'San Antonio de la Florida'"
CLUSTERS = f"""WITH RECURSIVE units AS (SELECT *, {KEY} AS unit FROM {UNITS_SQL}), pairs AS (SELECT * FROM {PAIRS_SQL}),
  links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
  cc(u, v) AS (SELECT unit, unit FROM units UNION SELECT cc.u, l.b FROM cc JOIN links l ON cc.v = l.a),
  comps AS (SELECT u AS vertex, min(v) AS comp FROM cc GROUP BY u)"""
MERGED_SQL = f"""SELECT municipality, display, number, comp, sum(x * n) / sum(n) AS x, sum(y * n) / sum(n) AS y,
  arg_min(base, (-total, base)) AS base, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT u.*, CASE WHEN {MERGE} THEN comp ELSE unit END AS comp, total FROM units u JOIN comps ON unit = vertex JOIN {TOTALS_SQL} t USING (municipality, base))
  GROUP BY municipality, display, number, comp"""
SN_SQL = f"""(SELECT *, CASE WHEN ref = '' THEN base || '-sn' ELSE base || '-sn-' || {sql.slug('ref')} END AS base_id FROM
  (SELECT municipality, base, CAST(round_even(x, 0) AS BIGINT) AS gx, CAST(round_even(y, 0) AS BIGINT) AS gy, avg(x) AS x, avg(y) AS y, min(ref) AS ref, min(display) AS display
   FROM {RURAL_SQL} WHERE number = 'S-N' GROUP BY 1, 2, 3, 4))"""
SN_PLACES = f"""SELECT municipality, CASE WHEN count(*) OVER (PARTITION BY municipality, base_id) = 1 THEN base_id ELSE base_id || '-' || gx || '-' || gy END AS id,
  display || ', S/N' AS name, display AS partida, 'S/N' AS num, round_even(lat, 6) AS lat, round_even(lng, 6) AS lng, {sql.ref_label('ref')} AS ref
  FROM {sql.with_utm(SN_SQL)}"""
NUMBERED_PLACES = f"""SELECT municipality, base || '-' || number AS id, display || ', ' || number AS name, display AS partida, number AS num,
  round_even(lat, 6) AS lat, round_even(lng, 6) AS lng, CAST(NULL AS VARCHAR) AS ref FROM {sql.with_utm('(' + MERGED_SQL + ')')}"""
ALL_PLACES = f"{NUMBERED_PLACES} UNION ALL {SN_PLACES}"


def rural(t: Tables):
    return ad.rural_addresses(t(inp.ADDRESSES))


def numbered(t: Tables):
    return ad.split_numbered(rural(t))[0]


def sn_records(t: Tables):
    return ad.split_numbered(rural(t))[1].withColumn("ref", text.parcel_ref("local_id"))


REFS = """SELECT c_custkey AS addr_id, CAST(0 AS INT) AS municipality, array(CAST(c_custkey % 37 AS STRING), CAST(c_custkey % 25 AS STRING)) AS tn_refs FROM {customer}"""


@query("j01_resolve_thoroughfare", "SELECT c_custkey AS addr_id, coalesce(a.n_name, b.n_name) AS raw_name FROM customer LEFT JOIN nation a ON a.n_nationkey = c_custkey % 37 LEFT JOIN nation b ON b.n_nationkey = c_custkey % 25 WHERE coalesce(a.n_name, b.n_name) IS NOT NULL")
def j01(t):
    known = t("SELECT CAST(0 AS INT) AS municipality, CAST(n_nationkey AS STRING) AS gml_id, n_name AS name FROM {nation}")
    return ad.resolve_thoroughfare(t(REFS), known).select("addr_id", "raw_name")


@query("j02_canonical_zone", f"SELECT addr_id, municipality, zone, display FROM {RURAL_SQL}")
def j02(t):
    return rural(t).select("addr_id", "municipality", "zone", "display")


LABELS = "SELECT concat(CAST(1000000 + s_suppkey * 6 AS STRING), 'XH9324N') AS ref, concat('Parcela ', CAST(s_suppkey AS STRING)) AS label FROM {supplier}"


@query("j03_ref_label_lookup", f"SELECT addr_id, {sql.ref_label('a.ref', 'label')} AS ref_label FROM (SELECT addr_id, regexp_extract(local_id, '[^.]*$') AS ref FROM ({ADDRESSES})) a LEFT JOIN ({duck(LABELS)}) l USING (ref)")
def j03(t):
    rows = t(inp.ADDRESSES).select("addr_id", text.parcel_ref("local_id").alias("ref"))
    return ad.with_ref_label(rows, t(LABELS)).select("addr_id", "ref_label")


@query("j04_close_pairs", f"SELECT a, b, round(dist_m, 3) AS dist_m FROM {PAIRS_SQL}")
def j04(t):
    return ad.close_pairs(ad.unit_centroids(numbered(t)), None).select("a", "b", F.round("dist_m", 3).alias("dist_m"))


@query("g01_clusters", f"{CLUSTERS} SELECT vertex, comp FROM comps")
def g01(t):
    units = cut(ad.unit_centroids(numbered(t)), "units")
    return components.connected_components(ad.close_links(units, None), units.select(ad.unit_key().alias("vertex")))


@query("a01_unit_centroids", f"SELECT municipality, display, number, base, round(x, 6) AS x, round(y, 6) AS y, n FROM {UNITS_SQL}")
def a01(t):
    units = ad.unit_centroids(numbered(t))
    return units.select("municipality", "display", "number", "base", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


@query("a02_legacy_totals", f"SELECT * FROM {TOTALS_SQL}")
def a02(t):
    return ad.legacy_totals(numbered(t))


@query("a03_a04_merged_clusters", f"{CLUSTERS} SELECT municipality, display, number, round(x, 6) AS x, round(y, 6) AS y, base, n FROM ({MERGED_SQL})")
def a03(t):
    rows = cut(numbered(t), "rural")
    merged = ad.clustered_units(cut(ad.unit_centroids(rows), "units"), ad.legacy_totals(rows))
    return merged.select("municipality", "display", "number", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "base", "n")


@query("a05_w01_sn_places", SN_PLACES)
def a05(t):
    return ad.sn_places(sn_records(t))


@query(
    "a11_build_report",
    f"""{CLUSTERS} SELECT 'addresses_read' AS metric, count(*) AS n FROM customer UNION ALL SELECT 'kept_numbered', count(*) FROM {RURAL_SQL} WHERE number <> 'S-N'
    UNION ALL SELECT 'kept_without_number', count(*) FROM {RURAL_SQL} WHERE number = 'S-N'
    UNION ALL SELECT 'type_' || code, count(*) FROM {RURAL_SQL} WHERE number <> 'S-N' GROUP BY code
    UNION ALL SELECT 'partidas', count(DISTINCT (municipality, display)) FROM {RURAL_SQL} WHERE number <> 'S-N'
    UNION ALL SELECT 'places', count(*) FROM ({ALL_PLACES})""",
)
def a11(t):
    rows = t(inp.ADDRESSES)
    return ad.build_report(rows, ad.build_places(rows))


@query(
    "a13_zone_density",
    f"""SELECT municipality, zone, CAST(sum(c) AS BIGINT) AS dwellings, CAST(count(*) AS DOUBLE) AS hectares, round(sum(c) / count(*), 6) AS density
    FROM (SELECT municipality, zone, floor(x / 100) AS cx, floor(y / 100) AS cy, count(*) AS c FROM {RURAL_SQL} GROUP BY ALL) GROUP BY 1, 2""",
)
def a13(t):
    return ad.zone_density(rural(t)).withColumn("density", F.round("density", 6))


@query("u01_t06_published_places", f"{CLUSTERS} SELECT * FROM ({ALL_PLACES}) ORDER BY municipality, partida, num, id")
def u01(t):
    return ad.published_order(ad.build_places(t(inp.ADDRESSES)))


SRS = "SELECT c_custkey AS addr_id, CASE WHEN c_acctbal < 0 THEN 'urn:ogc:def:crs:EPSG::25831' ELSE 'urn:ogc:def:crs:EPSG::25830' END AS srs FROM {customer}"


@query("q01_srs_guard", f"SELECT addr_id, srs FROM ({duck(SRS)}) WHERE srs <> 'urn:ogc:def:crs:EPSG::25830'")
def q01(t):
    return ad.check_srs(t(SRS))


ASKED = "SELECT CAST(n_nationkey AS BIGINT) AS query_id, CASE n_nationkey % 4 WHEN 0 THEN concat('boch ', CAST(n_nationkey AS STRING)) WHEN 1 THEN 'camino del' WHEN 2 THEN 'poligono' ELSE concat('florida ', CAST(n_nationkey AS STRING)) END AS text FROM {nation}"
# every place whose haystack has all tokens and whose number starts with the number
FLAGSHIP = f"""{CLUSTERS}, places AS (SELECT municipality AS town, *, {sql.haystack('name', 'partida', 'num', 'ref', sql.compact('ref'))} AS hay FROM ({ALL_PLACES})),
  q AS (SELECT query_id, {sql.tokens('text')} AS toks FROM ({duck(ASKED)})),
  p AS (SELECT *, CASE WHEN regexp_full_match(toks[-1], '[0-9]+') THEN toks[-1] ELSE '' END AS num_filter FROM q),
  r AS (SELECT *, CASE WHEN num_filter <> '' THEN toks[:-2] ELSE toks END AS names FROM p),
  one AS (SELECT query_id, town, partida, id FROM r JOIN places ON len(list_filter(names, lambda t: NOT contains(hay, t))) = 0 AND (num_filter = '' OR starts_with(num, num_filter))),
  two AS (SELECT query_id, town, partida, id FROM r JOIN places ON num_filter <> '' AND len(list_filter(toks, lambda t: NOT contains(hay, t))) = 0 WHERE query_id NOT IN (SELECT query_id FROM one)),
  g AS (SELECT query_id, town, partida, count(*) AS n, min(id) AS first_id FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2, 3)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, town, partida, n, first_id FROM (SELECT g.*, row_number() OVER (PARTITION BY query_id ORDER BY
    (CASE WHEN {sql.norm('partida')} = array_to_string(names, ' ') THEN 0 ELSE 1 END), n DESC, {sql.norm('partida')}, town, first_id) AS rank FROM g JOIN r USING (query_id)) WHERE rank <= 8"""


@query("flagship_address_search", FLAGSHIP)
def flagship(t):
    places = ad.build_places(t(inp.ADDRESSES)).withColumnRenamed("municipality", "town")
    blank = F.lit(None).cast("string")
    places = cut(places.withColumns({"address": blank, "notes": blank}).withColumn("hay", text.place_haystack()), "places")
    return search.search_groups(t(ASKED), places)
