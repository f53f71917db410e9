"""Inputs of the engine's operators, derived from whole given tables.

Every derivation is one SQL text that Spark and DuckDB both run; table names are in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW_NAMES = [
    # raw name, code, display zone, id slug
    ("PD BOCH, EL", "PD", "El Boch", "el-boch"),
    ("CM ALMAJAL DEL", "CM", "Camino del Almajal", "camino-del-almajal"),
    ("LG 2", "LG", "Lugar 2", "lugar-2"),
    ("PD MOCO EL GP.3", "PD", "El Moco", "moco-el-gp-3"),
    ("CL MAYOR", None, None, None),
    ("PL DISEMINADOS", "PL", "Diseminados", "diseminados"),
    ("CR ALICANTE-MURCIA", "CR", "Carretera Alicante-Murcia", "carretera-alicante-murcia"),
    ("PD D'EULA", "PD", "d'Eula", "d-eula"),
    ("PD S ROQUE", "PD", "San Roque", "s-roque"),
    ("PD S BA", "PD", "S Ba", "s-ba"),
    ("VR CMNO VIEJO", "VR", "Vereda Camino Viejo", "vereda-cmno-viejo"),
    ("PD HUERTA LA 17", "PD", "Huerta la 17", "huerta-la-17"),
    ("PL MOS DEL BOU", "PL", "Mos del Bou", "mos-del-bou"),
    ("PD S ANTONIO DE LA FLORIDA", "PD", "San Antonio de la Florida", "s-antonio-de-la-florida"),
    ("PD SAN ANTONIO FLORIDA", "PD", "San Antonio Florida", "san-antonio-florida"),
    ("PL PINAR DE BONANZA", "PL", "Pinar de Bonanza", "pinar-de-bonanza"),
]


def quote(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_NAME_CASES = " ".join(f"WHEN {i} THEN {quote_}" for i, quote_ in enumerate(quote(r[0]) for r in RAW_NAMES))

ADDRESSES = f"""
SELECT c_custkey AS addr_id,
       CASE c_nationkey % 5 WHEN 0 THEN '03005' WHEN 1 THEN '03059' WHEN 2 THEN '03015' WHEN 3 THEN '03049' ELSE '03099' END AS municipality,
       CASE c_custkey % {len(RAW_NAMES)} {_NAME_CASES} END AS raw_name,
       CASE WHEN c_custkey % 7 = 0 THEN 'S-N' ELSE CAST(CAST(floor(c_custkey / 80.0) AS BIGINT) % 9 AS STRING) END AS number,
       CAST(680000 + (CAST(floor(c_custkey / 80.0) AS BIGINT) % 9) * 300 + (c_custkey * 7919) % 197 AS DOUBLE) AS x,
       CAST(4215000 + (CAST(floor(c_custkey / 80.0) AS BIGINT) % 9) * 300 + (c_custkey * 104729) % 211 AS DOUBLE) AS y,
       concat('03.059.179.S-N.',
         CASE WHEN c_custkey % 3 = 0 THEN concat(CAST(1000000 + c_custkey AS STRING), 'XH9324N')
              ELSE concat('03059A', lpad(CAST(c_custkey % 150 AS STRING), 3, '0'), lpad(CAST(c_custkey AS STRING), 5, '0')) END) AS local_id
FROM {{customer}}"""

PLACES = """
SELECT p_type AS town, CAST(p_partkey AS STRING) AS id, p_brand AS partida, CAST(p_size AS STRING) AS num, p_name AS name,
       CAST(38.0 + floor(p_partkey / 45.0) * 0.002 AS DOUBLE) AS lat,
       CAST(-0.9 + (p_partkey % 45) * 0.002 AS DOUBLE) AS lng,
       CASE WHEN p_size % 10 = 0 THEN concat('Políg. ', CAST(p_size AS STRING), ' · Parc. ', CAST(p_partkey AS STRING)) END AS ref,
       CAST(NULL AS STRING) AS address, CAST(NULL AS STRING) AS notes
FROM {part}"""

TOWNS = """
SELECT town, row_number() OVER (ORDER BY town DESC) AS town_pos FROM (SELECT DISTINCT p_type AS town FROM {part}) t"""

QUERIES = """
SELECT CAST(n_nationkey AS BIGINT) AS query_id,
       CASE n_nationkey % 6 WHEN 0 THEN concat('Brand#', CAST(n_nationkey AS STRING), ' ', CAST(1 + n_nationkey % 9 AS STRING))
            WHEN 1 THEN 'RED  widget' WHEN 2 THEN concat('ring ', CAST(n_nationkey AS STRING))
            WHEN 3 THEN CAST(n_nationkey AS STRING) WHEN 4 THEN 'g small' ELSE concat('brand#1 ', '9999') END AS text
FROM {nation}"""

# the square lattice the places lie on; a street runs along every row and every column
NODES = """
SELECT p_partkey AS node_id, CAST(floor(p_partkey / 45.0) AS BIGINT) AS gy, p_partkey % 45 AS gx,
       CAST(38.0 + floor(p_partkey / 45.0) * 0.002 AS DOUBLE) AS lat,
       CAST(-0.9 + (p_partkey % 45) * 0.002 AS DOUBLE) AS lng
FROM {part}"""

EDGES = f"""
SELECT edge_id, a, b, cost_cs, oneway, cls, name, way_id FROM (
  SELECT u.node_id * 2 AS edge_id, u.node_id AS a, v.node_id AS b, CAST((u.node_id * 31) % 90 + 10 AS INT) AS cost_cs, u.node_id % 11 = 0 AS oneway,
         CASE WHEN u.gy % 5 = 0 THEN 'primary' ELSE 'track' END AS cls, concat('Calle ', CAST(u.gy AS STRING)) AS name, u.gy AS way_id
  FROM ({NODES}) u JOIN ({NODES}) v ON v.gy = u.gy AND v.gx = u.gx + 1
  UNION ALL
  SELECT u.node_id * 2 + 1, u.node_id, v.node_id, CAST((u.node_id * 17) % 90 + 10 AS INT), u.node_id % 13 = 0,
         'residential', CASE WHEN u.gx % 3 = 0 THEN concat('Avenida ', CAST(u.gx AS STRING)) END, 1000 + u.gx
  FROM ({NODES}) u JOIN ({NODES}) v ON v.gx = u.gx AND v.gy = u.gy + 1) e"""

# roads of one customer each: its orders in a row, from one junction to another, some one-way, some with hairpin bends
_CHAINS = """
SELECT o_orderkey, o_custkey, i, k, j, prev_key, c_a AS a, (c_a + 1 + o_custkey % (j - 1)) % j AS b FROM (
  SELECT o_orderkey, o_custkey, j, (o_custkey * 31) % j AS c_a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i,
         count(*) OVER (PARTITION BY o_custkey) AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev_key
  FROM {orders} JOIN (SELECT CAST(greatest(5, floor(count(*) / 10.0)) AS BIGINT) AS j FROM {customer}) n ON true) x"""

CHAIN_EDGES = f"""
SELECT o_orderkey AS edge_id, CASE WHEN i = 1 THEN a ELSE j + prev_key END AS a, CASE WHEN i = k THEN b ELSE j + o_orderkey END AS b,
       CAST(o_orderkey % 90 + 10 AS INT) AS cost_cs, o_custkey % 7 = 0 AS oneway, 'track' AS cls, CAST(NULL AS STRING) AS name, o_custkey AS way_id
FROM ({_CHAINS}) c"""

_LAT, _LNG = "CAST(38.0 + ({0} % 40) * 0.01 AS DOUBLE)", "CAST(-0.9 + floor({0} / 40.0) * 0.01 AS DOUBLE)"
_PART = "((i - CASE WHEN o_orderkey % 13 = 0 THEN 1.5 ELSE 0.0 END) / k)"

CHAIN_NODES = f"""
SELECT c_custkey - 1 AS node_id, {_LAT.format('(c_custkey - 1)')} AS lat, {_LNG.format('(c_custkey - 1)')} AS lng
FROM {{customer}} JOIN (SELECT CAST(greatest(5, floor(count(*) / 10.0)) AS BIGINT) AS j FROM {{customer}}) n ON true WHERE c_custkey <= j
UNION ALL
SELECT j + o_orderkey, CAST({_LAT.format('a')} + ({_LAT.format('b')} - {_LAT.format('a')}) * {_PART} AS DOUBLE),
       CAST({_LNG.format('a')} + ({_LNG.format('b')} - {_LNG.format('a')}) * {_PART} AS DOUBLE)
FROM ({_CHAINS}) c WHERE i < k"""

# the first edge of every third junction may not be followed by its last one
CHAIN_BANS = f"""
SELECT node AS via, min(edge_id) AS from_edge, max(edge_id) AS to_edge
FROM (SELECT edge_id, a AS node FROM ({CHAIN_EDGES}) e UNION ALL SELECT edge_id, b FROM ({CHAIN_EDGES}) e) x
  JOIN (SELECT CAST(greatest(5, floor(count(*) / 10.0)) AS BIGINT) AS j FROM {{customer}}) n ON true
WHERE node < j AND node % 3 = 0 GROUP BY node"""

CHAIN_PAIRS = """
SELECT c_custkey AS od_id, (CAST(floor(c_custkey / 50.0) AS BIGINT) * 31) % j AS origin, (c_custkey * 7 + 3) % j AS goal
FROM {customer} JOIN (SELECT CAST(greatest(5, floor(count(*) / 10.0)) AS BIGINT) AS j FROM {customer}) n ON true WHERE c_custkey % 50 = 0"""

# one-way chains of 1,200 customers, every other one closed to a ring, with suppliers on spurs, half of them two-way
CHAIN_LINKS = """
SELECT c_custkey AS tail, coalesce(lead(c_custkey) OVER (PARTITION BY chain ORDER BY c_custkey), CASE WHEN chain % 2 = 0 THEN min(c_custkey) OVER (PARTITION BY chain) END) AS head
FROM (SELECT c_custkey, CAST(floor((c_custkey - 1) / 1200.0) AS BIGINT) AS chain FROM {customer}) c
UNION ALL SELECT -s_suppkey, 1 + (s_suppkey * 7919) % n FROM {supplier} JOIN (SELECT count(*) AS n FROM {customer}) c ON true
UNION ALL SELECT 1 + (s_suppkey * 7919) % n, -s_suppkey FROM {supplier} JOIN (SELECT count(*) AS n FROM {customer}) c ON true WHERE s_suppkey % 2 = 0"""

WAY_VERTICES = """
SELECT l_orderkey AS way_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS BIGINT) AS pos,
       CAST(38.0 + (l_partkey % 400) * 0.001 AS DOUBLE) AS lat,
       CAST(-1.0 + (l_suppkey % 80) * 0.005 AS DOUBLE) AS lng
FROM {lineitem}"""

WAY_TAGS = """
SELECT o_orderkey AS way_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'track' WHEN 1 THEN 'residential' WHEN 2 THEN 'footway' WHEN 3 THEN 'primary' WHEN 4 THEN 'service' ELSE 'proposed' END AS highway,
       CASE o_custkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unknown' END AS motor_vehicle,
       CASE o_custkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'destination' END AS access,
       CASE o_orderkey % 7 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' END AS oneway,
       CASE WHEN o_orderkey % 9 = 0 THEN 'roundabout' END AS junction
FROM {orders}"""

RESTRICTIONS = """
SELECT s_suppkey AS rel_id, 46 + (s_suppkey * 37) % n AS via,
       CAST(floor((46 + (s_suppkey * 37) % n) / 45.0) AS BIGINT) AS from_way, 1000 + (46 + (s_suppkey * 37) % n) % 45 AS to_way,
       CASE s_suppkey % 5 WHEN 0 THEN 'no_left_turn' WHEN 1 THEN 'only_straight_on' WHEN 2 THEN 'no_u_turn' WHEN 3 THEN 'no_entry' ELSE 'other' END AS restriction,
       CASE WHEN s_suppkey % 11 = 0 THEN 'bicycle;motorcar' ELSE '' END AS except_val
FROM {supplier} JOIN (SELECT count(*) - 100 AS n FROM {part}) c ON true"""

OWN = """
SELECT CAST(s_suppkey * 7 AS STRING) AS id, concat('Casa ', CAST(s_suppkey * 5 AS STRING)) AS name, '' AS address, s_name AS notes,
       CAST(38.0 + (s_suppkey * 5) * 0.001 AS DOUBLE) AS lat, CAST(-0.9 AS DOUBLE) AS lng, 'c' AS created_at, 'u' AS updated_at
FROM {supplier}"""

INCOMING_ADDRESSES = """
SELECT c_custkey AS file_pos, CAST(c_custkey % 1000 AS STRING) AS id, concat(' Casa ', CAST(c_custkey % 700 AS STRING)) AS name,
       CAST(NULL AS STRING) AS address, c_mktsegment AS notes, CAST(38.0 + (c_custkey % 700) * 0.001 AS DOUBLE) AS lat,
       CAST(CASE WHEN c_custkey % 97 = 0 THEN 181 ELSE -0.9 END AS DOUBLE) AS lng, 'c' AS created_at, 'u' AS updated_at
FROM {customer}"""

TOWN_VERSIONS = """
SELECT CAST(n_nationkey AS STRING) AS town, n_name AS name, 1 + n_nationkey % 4 AS version, 1 + n_nationkey % 3 AS installed_version,
       n_nationkey % 5 <> 0 AS installed, n_nationkey % 2 = 0 AS visible
FROM {nation}"""

# installed places and the next snapshot: pending orders are gone, urgent ones moved, some new
INSTALLED = """
SELECT o_orderpriority AS town, concat(o_orderpriority, '/', CAST(o_orderkey AS STRING)) AS id, o_orderstatus AS name,
       o_totalprice AS lat, CAST(o_custkey AS DOUBLE) AS lng, o_custkey % 9 = 0 AS edited
FROM {orders}"""
SNAPSHOT = """
SELECT o_orderpriority AS town, CAST(o_orderkey AS STRING) AS id, CASE WHEN o_custkey % 4 = 0 THEN 'N' ELSE o_orderstatus END AS name,
       CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS lat, CAST(o_custkey AS DOUBLE) AS lng
FROM {orders} WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'
UNION ALL
SELECT '2-HIGH', concat('new', CAST(c_custkey AS STRING)), c_name, c_acctbal, CAST(c_nationkey AS DOUBLE) FROM {customer}"""

FIXES = """
SELECT user_id AS session_id, ts, event_id, CAST(38.0 + (event_id % 90) * 0.001 AS DOUBLE) AS lat,
       CAST(-0.9 + (event_id % 88) * 0.001 AS DOUBLE) AS lng, CAST(event_id % 60 AS DOUBLE) AS accuracy,
       CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 10 END AS DOUBLE) AS speed,
       CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 360 END AS DOUBLE) AS heading
FROM {events}"""

# one route per session: a polyline over the same area
ROUTE_POINTS = """
SELECT session_id AS route_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY c_custkey) - 1 AS BIGINT) AS pos,
       CAST(38.0 + (c_custkey * 37 % 90) * 0.001 AS DOUBLE) AS lat, CAST(-0.9 + (c_custkey * 53 % 88) * 0.001 AS DOUBLE) AS lng
FROM {customer} CROSS JOIN (SELECT count(DISTINCT user_id) AS users FROM {events}) u
  JOIN (SELECT DISTINCT user_id AS session_id FROM {events}) s ON session_id = c_custkey % users"""

# drives of six fixes each along a route of their own with one turn; a third of the fixes are off it, the last are near its end
DRIVES = """
SELECT CAST(floor(event_id / 6.0) AS BIGINT) AS session_id, ts, event_id, event_id AS fix_id,
       CAST(38.0 + (CAST(floor(event_id / 6.0) AS BIGINT) % 80) * 0.001 + greatest(event_id % 6 - 3, 0) * 0.0033 + CASE WHEN CAST(floor(value * 100) AS BIGINT) % 3 = 0 THEN 0.001 ELSE 0.0 END AS DOUBLE) AS lat,
       CAST(-0.9 + (CAST(floor(event_id / 6.0) AS BIGINT) % 70) * 0.001 + least(event_id % 6, 3) * 0.0033 AS DOUBLE) AS lng,
       CAST(5 AS DOUBLE) AS accuracy, CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 10 END AS DOUBLE) AS speed,
       CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 360 END AS DOUBLE) AS heading
FROM {events}"""

DRIVE_POINTS = """
SELECT session_id, pos, CAST(38.0 + (session_id % 80) * 0.001 + CASE WHEN pos = 2 THEN 0.01 ELSE 0.0 END AS DOUBLE) AS lat,
       CAST(-0.9 + (session_id % 70) * 0.001 + CASE WHEN pos = 0 THEN 0.0 ELSE 0.01 END AS DOUBLE) AS lng
FROM (SELECT DISTINCT CAST(floor(event_id / 6.0) AS BIGINT) AS session_id FROM {events}) s
  JOIN (SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS pos FROM {region} WHERE r_regionkey < 3) p ON true"""

_TABLE = re.compile(r"\{(\w+)\}")


class Tables:
    """The given tables of one folder and SQL over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __call__(self, sql: str) -> DataFrame:
        used = {name: self.table(name) for name in set(_TABLE.findall(sql))}
        return self.spark.sql(sql, **used)


def duck(sql: str) -> str:
    """The same SQL for DuckDB."""
    return _TABLE.sub(r"\1", sql)


def values(rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(quote(v) if not isinstance(v, (int, float)) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"
