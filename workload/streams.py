"""Streaming guidance over whole tables: the stream runs to its end and its output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.operators import routes
from sendero.plans.session import ROCKSDB, cut, scratch
from sendero.sources.fixes import read_fixes
from sendero.streaming.guidance import OUTPUT, guide, matched_fixes, route_table
from sendero.streaming.rerouting import Plans, Rerouting, straight_lines

from . import inputs as inp
from . import sql
from .functions import registry
from .inputs import Tables, duck
from .roads import DEGREES, FIXES, NEAREST, STEP_POINTS, STEPS

QUERIES, ORACLES, query = registry()


def fixes(t: Tables) -> DataFrame:
    return t(inp.FIXES).select(
        "session_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("fix_id"), "lat", "lng", "accuracy", "speed", "heading"
    )


def fix_stream(t: Tables) -> DataFrame:
    folder = scratch(t.spark, "fixes")
    fixes(t).write.parquet(folder)
    return read_fixes(t.spark, folder)


def route_rows(t: Tables) -> DataFrame:
    points = cut(t(STEP_POINTS), "points")
    steps = routes.route_steps(points, t(DEGREES)).withColumnRenamed("od_id", "session_id")
    totals = points.groupBy(F.col("od_id").alias("session_id")).agg(
        (F.max("od_id") * 10).cast("double").alias("duration_s"),
        F.max_by("lat", "pos").alias("dest_lat"),
        F.max_by("lng", "pos").alias("dest_lng"),
    )
    return cut(route_table(points.withColumnRenamed("od_id", "session_id"), steps, totals), "routes")


def run_stream(stream: DataFrame, schema: str) -> DataFrame:
    """Runs a stream over all it has and reads its Parquet output."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folder = scratch(spark, "stream")
    try:
        running = (
            stream.writeStream.trigger(availableNow=True)
            .option("checkpointLocation", f"{folder}/state")
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"))
            .start()
        )
        running.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(schema).parquet(f"{folder}/out/*")


PREPARED = f"""{STEPS}, rt AS (SELECT od_id AS session_id, max(cum) AS total, arg_max(lat, pos) AS dest_lat, arg_max(lng, pos) AS dest_lng, max(od_id) * 10.0 AS duration FROM c GROUP BY 1),
  x AS (SELECT f.*, n.dist_m, n.point_index, rt.* EXCLUDE (session_id), {sql.haversine('f.lat', 'f.lng', 'dest_lat', 'dest_lng')} AS dest_m, c.cum AS done
    FROM ({FIXES}) f JOIN rt ON rt.session_id = f.session_id JOIN {NEAREST} n ON n.fix_id = f.event_id JOIN c ON c.od_id = f.session_id AND c.pos = n.point_index),
  y AS (SELECT *, total - done AS remaining, (SELECT count(*) FROM steps s WHERE s.od_id = session_id AND type NOT IN ('depart', 'arrive') AND "at" >= point_index) AS turns,
    (SELECT arg_min(type, step) FROM steps s WHERE s.od_id = session_id AND type <> 'depart' AND "at" >= point_index) AS step_type FROM x),
  z AS (SELECT *, (CASE WHEN total > 0 THEN duration * remaining / total ELSE 0 END) * 1.4 + 10 * turns AS eta_s FROM y)"""
GUIDED = f"""{PREPARED}, hs AS (SELECT *, lag(lat) OVER w AS q_lat, lag(lng) OVER w AS q_lng, min(CASE WHEN dest_m <= 30 THEN ts END) OVER (PARTITION BY session_id) AS done_at FROM z WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
  hh AS (SELECT *, CASE WHEN speed IS NULL OR speed >= 1.5 THEN coalesce(heading, CASE WHEN q_lat IS NOT NULL AND {sql.haversine('q_lat', 'q_lng', 'lat', 'lng')} >= 8 THEN fmod({sql.bearing('q_lat', 'q_lng', 'lat', 'lng')} + 360, 360) END) END AS h
    FROM hs WHERE done_at IS NULL OR ts <= done_at),
  k AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS course,
    CASE WHEN dest_m > 30 AND dist_m > 35 THEN 1 ELSE 0 END AS off FROM hh),
  i AS (SELECT *, sum(1 - off) OVER (PARTITION BY session_id ORDER BY ts) AS isl FROM k),
  r AS (SELECT *, row_number() OVER (PARTITION BY session_id, isl, off ORDER BY ts) AS rn FROM i),
  o AS (SELECT *, CASE WHEN dest_m <= 30 THEN 'arrived' WHEN off = 1 AND rn % 2 = 0 THEN 'reroute' ELSE 'guidance' END AS kind FROM r)"""
ROUNDED = "round(dist_m, 3) AS dist_m, point_index, round(remaining, 3) AS remaining_m, step_type, round(eta_s, 3) AS eta_s"


@query("st01_st04_st06_matched_fixes", f"{PREPARED} SELECT event_id AS fix_id, {ROUNDED} FROM z")
def matched(t):
    df = matched_fixes(fix_stream(t), route_rows(t)).select("fix_id", "dist_m", "point_index", "remaining_m", "step_type", "eta_s")
    out = run_stream(df, "fix_id bigint, dist_m double, point_index bigint, remaining_m double, step_type string, eta_s double")
    return out.withColumns({c: F.round(c, 3) for c in ("dist_m", "remaining_m", "eta_s")})


@query(
    "st02_st03_st05_guidance",
    f"""{GUIDED} SELECT session_id, event_id AS fix_id, kind, round(course, 4) AS heading, CASE WHEN kind = 'guidance' THEN round(dist_m, 3) END AS dist_m,
    CASE WHEN kind = 'guidance' THEN point_index END AS point_index, CASE WHEN kind = 'guidance' THEN round(eta_s, 3) END AS eta_s FROM o""",
)
def guided(t):
    out = run_stream(guide(fix_stream(t), route_rows(t)), OUTPUT)
    return out.select(
        "session_id", "fix_id", "kind", F.round("heading", 4).alias("heading"), F.round("dist_m", 3).alias("dist_m"), "point_index", F.round("eta_s", 3).alias("eta_s")
    )


# --- the loop: requests are answered by a straight line to the destination, for two sessions of three


def drives(t: Tables) -> DataFrame:
    return t(inp.DRIVES).select(
        "session_id", F.col("ts").cast("timestamp").alias("ts"), "fix_id", "lat", "lng", "accuracy", "speed", "heading"
    )


def drive_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    points = t(inp.DRIVE_POINTS)
    turn = F.when(F.col("pos") == 0, "depart").when(F.col("pos") == 1, "left").otherwise("arrive")
    steps = points.select("session_id", F.col("pos").alias("step"), F.col("pos").alias("at"), turn.alias("type"), F.lit(None).cast("string").alias("name"))
    totals = points.filter("pos = 2").select("session_id", F.lit(300.0).alias("duration_s"), F.col("lat").alias("dest_lat"), F.col("lng").alias("dest_lng"))
    return points, steps, totals


_ON = f"SELECT s.session_id, pos, lat AS a_lat, lng AS a_lng, lead(lat) OVER w AS b_lat, lead(lng) OVER w AS b_lng FROM ({duck(inp.DRIVE_POINTS)}) s WINDOW w AS (PARTITION BY session_id ORDER BY pos)"
LOOP = f"""WITH RECURSIVE seg AS MATERIALIZED ({_ON}), leg AS MATERIALIZED (SELECT *, {sql.haversine('a_lat', 'a_lng', 'b_lat', 'b_lng')} AS hop FROM seg WHERE b_lat IS NOT NULL),
  fx AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts) AS i FROM ({duck(inp.DRIVES)})),
  near AS (SELECT f.fix_id, min(d) AS d0, arg_min(pos, (d, pos)) AS p0 FROM (SELECT f.fix_id, pos, {sql.segment_dist('f.lat', 'f.lng', 'a_lat', 'a_lng', 'b_lat', 'b_lng')} AS d FROM fx f JOIN leg USING (session_id)) f GROUP BY 1),
  size AS (SELECT session_id, sum(hop) AS total, max(CASE WHEN pos = 0 THEN hop END) AS hop0 FROM leg GROUP BY 1),
  x AS MATERIALIZED (SELECT fx.*, d0, p0, total - CASE WHEN p0 = 1 THEN hop0 ELSE 0 END AS r0, e.a_lat AS y, e.a_lng AS x, {sql.haversine('fx.lat', 'fx.lng', 'e.a_lat', 'e.a_lng')} AS dest
    FROM fx JOIN near USING (fix_id) JOIN size USING (session_id) JOIN seg e ON e.session_id = fx.session_id AND e.pos = 2),
  st(session_id, i, fix_id, off, version, y0, x0, kind, dist_m, point_index, remaining_m) AS (
    SELECT DISTINCT session_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'start', CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM x
    UNION ALL
    SELECT session_id, i, fix_id, CASE WHEN kind = 'guidance' THEN o ELSE 0 END, version + CASE WHEN kind = 'reroute' AND session_id % 3 <> 0 THEN 1 ELSE 0 END,
      CASE WHEN kind = 'reroute' AND session_id % 3 <> 0 THEN lat ELSE y0 END, CASE WHEN kind = 'reroute' AND session_id % 3 <> 0 THEN lng ELSE x0 END, kind,
      CASE WHEN kind = 'guidance' THEN d END, CASE WHEN kind = 'guidance' THEN CASE WHEN y0 IS NULL THEN p0 ELSE 0 END WHEN kind = 'reroute' AND session_id % 3 <> 0 THEN 0 END,
      CASE WHEN kind = 'guidance' THEN CASE WHEN y0 IS NULL THEN r0 ELSE {sql.haversine('y0', 'x0', 'y', 'x')} END WHEN kind = 'reroute' AND session_id % 3 <> 0 THEN dest END
    FROM (SELECT *, CASE WHEN dest <= 30 THEN 'arrived' WHEN o >= 2 THEN 'reroute' ELSE 'guidance' END AS kind FROM (
      SELECT *, CASE WHEN d > 35 THEN off + 1 ELSE 0 END AS o FROM (
        SELECT x.*, st.off, st.version, st.y0, st.x0, CASE WHEN st.y0 IS NULL THEN d0 ELSE {sql.segment_dist('x.lat', 'x.lng', 'st.y0', 'st.x0', 'x.y', 'x.x')} END AS d
        FROM st JOIN x ON x.session_id = st.session_id AND x.i = st.i + 1 WHERE st.kind <> 'arrived') a) b) c)"""


@query(
    "st03_reroute_loop",
    f"{LOOP} SELECT session_id, fix_id, kind, version, round(dist_m, 2) AS dist_m, point_index, round(remaining_m, 2) AS remaining_m FROM st WHERE i > 0",
)
def looped(t):
    folder, source = scratch(t.spark, "loop"), scratch(t.spark, "drives")
    drives(t).write.parquet(source)
    plans = Plans.of(*(df.withColumn("version", F.lit(0).cast("bigint")) for df in drive_tables(t)))
    loop = Rerouting(t.spark, folder, plans, lambda asked: straight_lines(asked.filter("session_id % 3 <> 0")))
    loop.start(read_fixes(t.spark, source)).awaitTermination()
    rounded = [F.round(c, 2).alias(c) for c in ("dist_m", "remaining_m")]
    return loop.records().select("session_id", "fix_id", "kind", "version", "point_index", *rounded)


LATENESS_DAYS, IDLE_DAYS = 10, 2
# a fifth of the fixes come in a second delivery; what came before them in their session makes most of them late. The
# watermark of the first delivery does not yet bar the second, so every late fix is told
EXPIRED = f"""WITH f AS (SELECT session_id, fix_id, ts, fix_id % 5 = 0 AS second FROM ({duck(inp.DRIVES)})),
  m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {LATENESS_DAYS} DAY AS w FROM f),
  s AS (SELECT session_id, max(ts) AS last, max(CASE WHEN NOT second THEN ts END) AS seen FROM f GROUP BY 1)
  SELECT f.session_id, fix_id, 'late' AS kind FROM f JOIN s USING (session_id) WHERE second AND ts <= seen
  UNION ALL SELECT session_id, NULL, 'expired' FROM s, m WHERE date_trunc('milliseconds', last) + INTERVAL {IDLE_DAYS} DAY <= w"""


@query("st07_late_and_expired", EXPIRED)
def expired(t):
    source = scratch(t.spark, "deliveries")
    for second in (False, True):
        part = drives(t).filter((F.col("fix_id") % 5 == 0) == second)
        part.repartition(4, "fix_id").write.mode("append").parquet(source)
    points, steps, totals = drive_tables(t)
    fixes = read_fixes(t.spark, source, maxFilesPerTrigger=4)
    rows = guide(fixes, cut(route_table(points, steps, totals), "routes"), idle_ms=IDLE_DAYS * 86_400_000, lateness=f"{LATENESS_DAYS} days")
    return run_stream(rows, OUTPUT).filter("kind IN ('late', 'expired')").select("session_id", "fix_id", "kind")
