"""Dataset lifecycle over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sendero.operators import datasets as ds

from . import inputs as inp
from . import sql
from .functions import registry
from .inputs import Tables, duck

QUERIES, ORACLES, query = registry()

INSTALLED, SNAPSHOT = duck(inp.INSTALLED), duck(inp.SNAPSHOT)
FRESH = f"(SELECT town, town || '/' || id AS id, name, lat, lng, false AS edited FROM ({SNAPSHOT}))"


def installed(t: Tables):
    return t(inp.INSTALLED)


def incoming(t: Tables):
    return ds.town_places(t(inp.SNAPSHOT))


@query(
    "j05_refresh_towns",
    f"""SELECT * FROM ({INSTALLED}) WHERE edited OR town NOT IN (SELECT town FROM {FRESH})
    UNION ALL SELECT f.* FROM {FRESH} f WHERE NOT EXISTS (SELECT 1 FROM ({INSTALLED}) i WHERE i.edited AND i.id = f.id)""",
)
def j05(t):
    return ds.refresh_towns(installed(t), incoming(t))


EDITS = """SELECT l_orderkey * 10 + l_linenumber AS file_pos, o_orderpriority AS town,
  CASE WHEN l_linenumber = 7 THEN CAST(NULL AS STRING) ELSE concat(o_orderpriority, '/', CAST(l_orderkey AS STRING)) END AS id,
  l_returnflag AS name, 'P' AS partida, CAST(l_linenumber AS STRING) AS num, CAST(NULL AS STRING) AS ref,
  CAST(l_quantity * 2 AS DOUBLE) AS lat, CAST(l_linenumber AS DOUBLE) AS lng, '' AS address, l_linestatus AS notes, '2026' AS updated_at
  FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_quantity) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l
  JOIN {orders} ON o_orderkey = l_orderkey"""
JUDGED = f"""(SELECT *, CASE WHEN id IS NULL OR abs(lat) > 90 THEN 'invalid' WHEN id IN (SELECT id FROM ({INSTALLED}) WHERE edited) THEN 'conflict' ELSE 'added' END AS outcome FROM ({duck(EDITS)}))"""
APPLIED = f"(SELECT id, arg_max(town, file_pos) AS town, arg_max(name, file_pos) AS name, arg_max(lat, file_pos) AS lat, arg_max(lng, file_pos) AS lng, true AS edited FROM {JUDGED} WHERE outcome = 'added' GROUP BY id)"


@query(
    "j06_import_edits",
    f"SELECT town, id, name, lat, lng, edited FROM ({INSTALLED}) WHERE id NOT IN (SELECT id FROM {APPLIED}) UNION ALL SELECT town, id, name, lat, lng, edited FROM {APPLIED}",
)
def j06(t):
    places, _ = ds.import_edits(installed(t), t(EDITS))
    return places.select("town", "id", "name", "lat", "lng", "edited")


@query(
    "j06_import_edits_report",
    f"SELECT count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'conflict') AS conflicts, count(*) FILTER (outcome = 'invalid') AS invalid FROM {JUDGED}",
)
def j06_report(t):
    return ds.import_edits(installed(t), t(EDITS))[1]


# row by row, carrying what is taken
GREEDY = f"""WITH RECURSIVE inc AS (SELECT row_number() OVER (ORDER BY file_pos) AS k, id, trim(name) AS name, notes, lat, lng, {sql.norm('trim(name)')} || '|' || printf('%.6f', lat) || '|' || printf('%.6f', lng) AS sig
    FROM ({duck(inp.INCOMING_ADDRESSES)}) WHERE abs(lat) <= 90 AND abs(lng) <= 180),
  own AS (SELECT *, {sql.norm('trim(name)')} || '|' || printf('%.6f', lat) || '|' || printf('%.6f', lng) AS sig FROM ({duck(inp.OWN)})),
  step(k, ids, sigs, taken) AS (
    SELECT CAST(0 AS BIGINT), (SELECT list(id) FROM own), (SELECT list(sig) FROM own), false
    UNION ALL
    SELECT inc.k, CASE WHEN ok THEN list_append(ids, inc.id) ELSE ids END, CASE WHEN ok THEN list_append(sigs, inc.sig) ELSE sigs END, ok
    FROM (SELECT s.*, NOT list_contains(ids, i.id) AND NOT list_contains(sigs, i.sig) AS ok, i.k AS nk FROM step s JOIN inc i ON i.k = s.k + 1) z JOIN inc ON inc.k = z.nk),
  added AS (SELECT inc.* FROM step JOIN inc USING (k) WHERE taken)"""


@query("j07_w11_import_addresses", f"{GREEDY} SELECT id, name, notes, lat, lng FROM own UNION ALL SELECT id, name, notes, lat, lng FROM added")
def j07(t):
    merged, _ = ds.import_addresses(t(inp.OWN), t(inp.INCOMING_ADDRESSES))
    return merged.select("id", "name", "notes", "lat", "lng")


@query(
    "a14_import_summary",
    f"""{GREEDY} SELECT (SELECT count(*) FROM added) AS points, CAST(e.added AS BIGINT) AS corrections,
    (SELECT count(*) FROM inc) - (SELECT count(*) FROM added) + e.conflicts AS conflicts, (SELECT count(*) FROM customer) - (SELECT count(*) FROM inc) + e.invalid AS invalid
    FROM (SELECT count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'conflict') AS conflicts, count(*) FILTER (outcome = 'invalid') AS invalid FROM {JUDGED}) e""",
)
def a14(t):
    _, report = ds.import_addresses(t(inp.OWN), t(inp.INCOMING_ADDRESSES))
    return ds.import_summary(report, ds.import_edits(installed(t), t(EDITS))[1])


@query("a14_edited_counts", f"SELECT town, count(*) FILTER (edited) AS edited, count(*) AS places FROM ({INSTALLED}) GROUP BY town")
def a14_edited(t):
    return ds.edited_counts(installed(t))


VERSIONS = duck(inp.TOWN_VERSIONS)


def on_device(t: Tables):
    return t(inp.TOWN_VERSIONS).filter("installed").select("town", F.when(F.col("version") > 2, F.upper("name")).alias("name"), F.col("installed_version").alias("version"), "visible")


def manifest(t: Tables):
    return t(inp.TOWN_VERSIONS).select("town", "name", "version")


@query("j08_outdated_towns", f"SELECT town, version, installed_version FROM ({VERSIONS}) WHERE installed AND version > installed_version")
def j08(t):
    return ds.outdated(manifest(t), on_device(t)).select("town", "version", "installed_version")


@query("j08_artifacts_needed", f"SELECT name, version FROM ({VERSIONS}) WHERE NOT installed OR version > installed_version")
def j08_artifacts(t):
    return ds.artifacts_needed(manifest(t).drop("town"), t(inp.TOWN_VERSIONS).filter("installed").select("name", F.col("installed_version").alias("version")), on_device(t)).select("name", "version")


CHANGES = f"""(SELECT coalesce(o.id, n.id) AS id, coalesce(o.town, n.town) AS town, o.id IS NULL AS is_added, n.id IS NULL AS is_lost,
  (o.lat IS DISTINCT FROM n.lat OR o.lng IS DISTINCT FROM n.lng) AS d1, o.name IS DISTINCT FROM n.name AS d2
  FROM ({INSTALLED}) o FULL JOIN {FRESH} n ON o.id = n.id AND o.town = n.town)"""
DIFF = f"""SELECT town, id, 'lost' AS change FROM {CHANGES} WHERE is_lost UNION ALL SELECT town, id, 'added' FROM {CHANGES} WHERE is_added
  UNION ALL SELECT town, id, 'moved' FROM {CHANGES} WHERE NOT is_lost AND NOT is_added AND d1 UNION ALL SELECT town, id, 'renamed' FROM {CHANGES} WHERE NOT is_lost AND NOT is_added AND d2"""


@query("j14_diff_snapshots", DIFF)
def j14(t):
    return ds.diff_snapshots(installed(t), incoming(t), ["town", "id"], ["lat", "lng"], ["name"])


@query("j17_town_label", f"SELECT town, coalesce(CASE WHEN installed AND version > 2 THEN upper(name) END, name) AS town_label FROM ({VERSIONS})")
def j17(t):
    return ds.with_town_label(t(inp.TOWN_VERSIONS).select("town"), on_device(t), manifest(t)).select("town", "town_label")


PLACES = duck(inp.PLACES)


@query("p10_active_towns", f"SELECT id FROM ({PLACES}) WHERE town IN (SELECT DISTINCT town FROM ({duck(inp.TOWNS)}) WHERE town_pos > 5)")
def p10(t):
    towns = t(inp.TOWNS).withColumn("visible", F.col("town_pos") > 5)
    return ds.active_towns(towns, t(inp.PLACES)).select("id")


@query("u05_delete_towns", f"SELECT id FROM ({INSTALLED}) WHERE NOT (town IN ('2-HIGH', '5-LOW') AND NOT edited)")
def u05(t):
    gone = installed(t).filter(F.col("town").isin("2-HIGH", "5-LOW")).select("town")
    return ds.delete_towns(installed(t), gone, keep_edited=True).select("id")


@query("t08_recent_first", "SELECT o_orderkey AS id, CAST(o_orderdate AS VARCHAR) AS created_at FROM orders ORDER BY created_at DESC, id")
def t08(t):
    return ds.recent_first(t("SELECT o_orderkey AS id, CAST(o_orderdate AS STRING) AS created_at FROM {orders}"))


@query(
    "s10_upsert_manifest",
    f"SELECT town AS id, name, version FROM ({VERSIONS}) WHERE NOT installed UNION ALL SELECT town, lower(name), version + 1 FROM ({VERSIONS}) WHERE installed",
)
def s10(t):
    old = manifest(t).withColumnRenamed("town", "id")
    new = t(inp.TOWN_VERSIONS).filter("installed").select(F.col("town").alias("id"), F.lower("name").alias("name"), (F.col("version") + 1).alias("version"))
    return ds.upsert_manifest(old, new)


GATE_ROWS = """SELECT o_orderpriority AS town, CAST(o_orderkey AS STRING) AS id, o_orderstatus AS name, o_orderstatus AS partida,
  CASE WHEN o_custkey % 8 = 0 THEN 'S/N' ELSE CAST(o_custkey AS STRING) END AS num, o_totalprice AS lat, CAST(o_custkey AS DOUBLE) AS lng,
  CASE WHEN o_custkey % 12 = 0 THEN 'Ref. 1' END AS ref FROM {orders}"""


@query(
    "q04_release_gate",
    f"""SELECT 'lost_ids' AS "check", count(*) AS violations FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'moved_ids', count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'duplicate_ids', 0 UNION ALL SELECT 'numbered_with_ref', count(*) FROM ({duck(GATE_ROWS)}) WHERE name <> 'P' AND num <> 'S/N' AND ref IS NOT NULL
    UNION ALL SELECT 'unnumbered_without_ref', count(*) FROM ({duck(GATE_ROWS)}) WHERE name <> 'P' AND num = 'S/N' AND ref IS NULL""",
)
def q04(t):
    old = t(GATE_ROWS)
    new = old.filter("name <> 'P'").withColumn("lat", F.when(F.col("town") == "1-URGENT", F.col("lat") + 1).otherwise(F.col("lat")))
    return ds.release_gate(old, new)


@query(
    "q05_next_version",
    f"""SELECT n.town, CAST(CASE WHEN o.town IS NULL THEN 1 WHEN c.town IS NULL THEN length(n.town) ELSE length(n.town) + 1 END AS INTEGER) AS version
    FROM (SELECT DISTINCT name AS town FROM ({duck(GATE_ROWS)})) n LEFT JOIN (SELECT DISTINCT name AS town FROM ({duck(GATE_ROWS)}) WHERE name <> 'O') o USING (town)
    LEFT JOIN (SELECT DISTINCT name AS town FROM ({duck(GATE_ROWS)}) WHERE name = 'F') c USING (town)""",
)
def q05(t):
    # orders by status: O has no version yet, F changes, P stays as it is
    new = t(GATE_ROWS).withColumn("town", F.col("name"))
    old = new.filter("town <> 'O'").withColumn("version", F.length("town"))
    old = old.withColumn("lat", F.when(F.col("town") == "F", F.col("lat") - 1).otherwise(F.col("lat")))
    return ds.next_version(old, new, ["id", "partida", "num", "lat", "lng", "ref"])


@query("w09_dedup_last", "SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey)) AS l_partkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def w09(t):
    rows = t("SELECT l_orderkey, l_partkey, l_linenumber FROM {lineitem}")
    return ds.dedup_last(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"])


@query("w11_dedup_first", "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def w11(t):
    rows = t("SELECT l_orderkey, l_partkey, l_linenumber FROM {lineitem}")
    return ds.dedup_first(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"])
