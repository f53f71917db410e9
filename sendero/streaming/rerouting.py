"""Guidance with its feedback loop: a request for a new route is answered, and the session goes on along it.

Each micro-batch is a set of joins and windows over all its fixes; there is no row loop. Fixes of a session
are taken up to the first that arrives or asks for a new route; the requests of all sessions are answered together
by ``recompute``; what is left of those sessions goes on with the new version of their route, or with the old one
where no route was found. That repeats until no fix is left, so a batch takes as many steps as the most requests of
one session in it.

Routes, sessions and answers are tables in a folder every executor reaches. A batch reads what the batch before it
left and writes its own, so a batch that is run again gives the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions import geo, guidance
from ..operators.routes import measured_points, nearest_on_route
from ..operators.tracks import HOUR_S, off_route_streaks
from ..plans.session import cut

SESSIONS = (
    "session_id bigint, version bigint, off int, arrived boolean, last_lat double, last_lng double, heading double, last_us bigint"
)
GUIDED = (
    "session_id bigint, fix_id bigint, ts timestamp, kind string, version bigint, heading double, dist_m double, point_index bigint, "
    "remaining_m double, step_dist_m double, step_type string, step_name string, eta_s double, label string"
)
def _at() -> Column:
    """Order of the fixes of a batch: those of equal times are taken by id."""
    return F.struct("us", "fix_id")


class Plans:
    """Versions of the routes of sessions: points(session_id, version, pos, lat, lng, cum_m),
    steps(session_id, version, step, at, type, name), totals(session_id, version, duration_s, dest_lat, dest_lng, total_m)."""

    def __init__(self, points: DataFrame, steps: DataFrame, totals: DataFrame):
        self.points, self.steps, self.totals = points, steps, totals

    @classmethod
    def of(cls, points: DataFrame, steps: DataFrame, totals: DataFrame) -> Plans:
        """points(session_id, version, pos, lat, lng), steps, totals(session_id, version, duration_s, dest_lat, dest_lng).

        Totals may name sessions without points: those get straight-line guidance.
        """
        keys = ["session_id", "version"]
        measured = measured_points(points.select(*keys, "pos", "lat", "lng"), keys)
        length = measured.groupBy(*keys).agg(F.max("cum_m").alias("total_m"))
        return cls(
            cut(measured.select(*keys, "pos", "lat", "lng", "cum_m"), "points"),
            cut(steps.select(*keys, "step", "at", "type", "name"), "steps"),
            cut(totals.select(*keys, "duration_s", "dest_lat", "dest_lng").join(length, keys, "left"), "totals"),
        )

    def with_more(self, other: Plans) -> Plans:
        return Plans(
            self.points.unionByName(other.points), self.steps.unionByName(other.steps), self.totals.unionByName(other.totals)
        )


def carried(rows: DataFrame, value: str, name: str, block_s: int = HOUR_S) -> DataFrame:
    """Adds the last value that is not null up to and including each row of rows(session_id, us, fix_id, ...).

    Hours are windows of their own, and what they end with is carried over, so a long session is many tasks.
    """
    hour = F.floor(F.col("us") / (block_s * 1_000_000))
    rows = rows.withColumn("_hour", hour)
    ends = rows.groupBy("session_id", "_hour").agg(F.max_by(value, F.when(F.col(value).isNotNull(), _at())).alias("_end"))
    before = W.partitionBy("session_id").orderBy("_hour").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    inner = W.partitionBy("session_id", "_hour").orderBy("us", "fix_id").rowsBetween(W.unboundedPreceding, 0)
    filled = rows.join(ends, ["session_id", "_hour"])
    return filled.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inner), F.col("_before"))).drop("_hour", "_before")


def with_heading(fixes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds verified, the verified heading at each fix, to fixes(session_id, us, fix_id, lat, lng, speed, course)."""
    known = sessions.filter("last_us IS NOT NULL").select(
        "session_id", F.col("last_us").alias("us"), F.col("last_lat").alias("lat"), F.col("last_lng").alias("lng"),
        F.col("heading").alias("h"), F.lit(True).alias("old"),
    )
    rows = fixes.withColumn("old", F.lit(False)).unionByName(known, allowMissingColumns=True)
    # the place of the fix before, over the edges of hours too
    rows = rows.withColumn("here", F.struct("us", "fix_id", "lat", "lng"))
    hour = F.floor(F.col("us") / (HOUR_S * 1_000_000))
    ends = rows.groupBy("session_id", hour.alias("_hour")).agg(F.max("here").alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(W.partitionBy("session_id").orderBy("_hour"))).drop("_end")
    rows = rows.withColumn("_hour", hour).join(ends, ["session_id", "_hour"])
    last = F.coalesce(F.lag("here").over(W.partitionBy("session_id", "_hour").orderBy("us", "fix_id")), F.col("_before"))
    rows = rows.withColumn("last", last).drop("_hour", "_before")
    moving = F.col("speed").isNull() | F.isnan("speed") | (F.col("speed") >= fx.HEADING_MIN_SPEED_MS)
    course = F.when(~F.isnan("course"), F.col("course"))
    far = geo.haversine_m("last.lat", "last.lng", "lat", "lng") >= fx.HEADING_MIN_MOVE_M
    turned = F.when(far, F.pmod(geo.bearing_deg("last.lat", "last.lng", "lat", "lng") + 360.0, F.lit(360.0)))
    rows = rows.withColumn("h", F.when(F.col("old"), F.col("h")).when(moving, F.coalesce(course, turned)))
    return carried(rows, "h", "verified").filter("NOT old").drop("here", "last", "h", "old")


def guided(fixes: DataFrame, plans: Plans) -> DataFrame:
    """fixes(session_id, version, fix_id, lat, lng, ...) with dest_m, dist_m, point_index and a guidance record.

    A session without a route gets what is left in a straight line to its destination.
    """
    keys = ["session_id", "version"]
    route = F.struct(*keys)
    near = nearest_on_route(
        fixes.select(F.struct("session_id", "fix_id").alias("fix_id"), route.alias("route_id"), "lat", "lng"),
        plans.points.select(route.alias("route_id"), "pos", "lat", "lng"),
    ).select("fix_id.*", "dist_m", "point_index")
    return _recorded(fixes.join(near, ["session_id", "fix_id"], "left"), plans)


def _recorded(fixes: DataFrame, plans: Plans) -> DataFrame:
    """Guidance records of fixes whose point_index on their route is known."""
    keys = ["session_id", "version"]
    reached = plans.points.select(*keys, F.col("pos").alias("point_index"), F.col("cum_m").alias("done_m"))
    joined = fixes.join(plans.totals, keys).join(reached, [*keys, "point_index"], "left")
    ahead = plans.steps.filter("type <> 'depart'").select(*keys, "step", "at", "type", "name")
    asked = joined.filter("point_index IS NOT NULL").select(*keys, "point_index").distinct()
    coming = asked.join(ahead, keys).filter("at >= point_index").groupBy(*keys, "point_index").agg(
        F.min(F.struct("step", "at", "type", "name")).alias("next"), F.count_if(F.col("type") != "arrive").alias("turns")
    )
    at = plans.points.select(*keys, F.col("pos").alias("next_at"), F.col("cum_m").alias("next_m"))
    coming = coming.withColumn("next_at", F.col("next.at")).join(at, [*keys, "next_at"], "left").drop("next_at")
    rows = joined.join(coming, [*keys, "point_index"], "left")
    dest = geo.haversine_m("lat", "lng", "dest_lat", "dest_lng")
    left = F.when(F.col("done_m").isNull(), dest).otherwise(F.greatest(F.lit(0.0), F.col("total_m") - F.col("done_m")))
    raw = F.when(F.col("done_m").isNull(), F.col("duration_s")).otherwise(guidance.raw_eta_s("duration_s", left, "total_m"))
    kind = F.coalesce("next.type", F.lit("straight"))
    return rows.withColumns(
        {
            "dest_m": dest,
            "remaining_m": left,
            "step_dist_m": F.coalesce(F.greatest(F.lit(0.0), F.col("next_m") - F.col("done_m")), left),
            "step_type": kind,
            "step_name": F.col("next.name"),
            "eta_s": guidance.eta_s(raw, "turns"),
            "label": guidance.maneuver_label(kind, "next.name"),
        }
    ).drop("next", "next_m", "done_m", "turns", "duration_s", "dest_lat", "dest_lng", "total_m")


class Rerouting:
    """``start`` runs the loop over a stream; ``batch`` does one micro-batch.

    recompute(requests(session_id, version, lat, lng, dest_lat, dest_lng)) gives Plans of the requests it found a route for,
    under the version asked for. Sessions without a plan are ignored.
    """

    def __init__(self, spark: SparkSession, folder: str, plans: Plans, recompute: Callable[[DataFrame], Plans]):
        self.spark, self.folder, self.first, self.recompute = spark, folder.rstrip("/"), plans, recompute

    def start(self, fixes: DataFrame):
        """A running query that writes guidance records; read them with ``records``."""
        return (
            fixes.writeStream.trigger(availableNow=True)
            .option("checkpointLocation", f"{self.folder}/offsets")
            .foreachBatch(self.batch)
            .start()
        )

    def records(self) -> DataFrame:
        return self.spark.read.schema(GUIDED).parquet(f"{self.folder}/guided/*")

    def sessions(self, batch: int) -> DataFrame:
        """Sessions as they were before a batch."""
        if batch:
            return self.spark.read.schema(SESSIONS).parquet(f"{self.folder}/sessions/batch={batch - 1}")
        newest = self.first.totals.groupBy("session_id").agg(F.max("version").alias("version"))
        none = lambda kind: F.lit(None).cast(kind)
        return newest.select(
            "session_id", "version", F.lit(0).alias("off"), F.lit(False).alias("arrived"), none("double").alias("last_lat"),
            none("double").alias("last_lng"), none("double").alias("heading"), none("bigint").alias("last_us"),
        )

    def plans(self, batch: int) -> Plans:
        """All versions of routes known before a batch."""
        if not batch:
            return self.first
        folder = f"{self.folder}/plans/batch={batch - 1}"
        return Plans(*(self.spark.read.parquet(f"{folder}/{name}") for name in ("points", "steps", "totals")))

    def batch(self, fixes: DataFrame, batch: int) -> None:
        sessions, plans = self.sessions(batch), self.plans(batch)
        valid = fixes.filter(geo.valid_coords("lat", "lng")).withColumn("us", F.unix_micros("ts"))
        new = valid.join(sessions.select("session_id", "arrived", "last_us"), "session_id")
        new = new.filter("NOT arrived AND (last_us IS NULL OR us > last_us)")
        first = new.groupBy("session_id", "us", "fix_id").agg(F.min(F.struct("ts", "lat", "lng", "speed", "heading")).alias("f"))
        first = first.select("session_id", "us", "fix_id", "f.ts", "f.lat", "f.lng", "f.speed", F.col("f.heading").alias("course"))
        rest = cut(with_heading(first, sessions), "fixes")
        written, active = [], sessions.select("session_id", "version", "off", "last_us")
        while not rest.isEmpty():
            met = cut(guided(rest.join(active.select("session_id", "version"), "session_id"), plans), "met")
            seen = met.select("session_id", "ts", "us", "fix_id", F.coalesce("dist_m", F.lit(0.0)).alias("dist_m"))
            open_streak = active.filter("off > 0 AND last_us IS NOT NULL").select(
                "session_id", F.timestamp_micros("last_us").alias("ts"), F.col("last_us").alias("us"),
                F.lit(-1).cast("bigint").alias("fix_id"), F.lit(2.0 * fx.OFF_ROUTE_M).alias("dist_m"),
            )
            streaks = off_route_streaks(seen.unionByName(open_streak.join(seen.select("session_id").distinct(), "session_id")))
            asks = streaks.filter("reroute").groupBy("session_id").agg(F.min(_at()).alias("asked_at"))
            ends = met.filter(F.col("dest_m") <= fx.ARRIVE_M).groupBy("session_id").agg(F.min(_at()).alias("arrived_at"))
            stops = asks.join(ends, "session_id", "full").withColumn("stop", F.least("asked_at", "arrived_at"))
            arrived = F.col("arrived_at").isNotNull() & (F.col("arrived_at") == F.col("stop"))
            stops = cut(stops.select("session_id", "stop", arrived.alias("arrived")), "stops")
            done = met.join(stops, "session_id", "left").filter(F.col("stop").isNull() | (_at() <= F.col("stop")))
            kind = F.when(_at() == F.col("stop"), F.when(F.col("arrived"), "arrived").otherwise("reroute")).otherwise("guidance")
            done = cut(done.withColumn("kind", F.coalesce(kind, F.lit("guidance"))), "done")
            requests = done.filter("kind = 'reroute'")
            asked = requests.select("session_id", (F.col("version") + 1).alias("version"), "lat", "lng", "fix_id", "ts", "us", "verified", "kind")
            targets = plans.totals.select("session_id", (F.col("version") + 1).alias("version"), "dest_lat", "dest_lng")
            answered = self.recompute(asked.select("session_id", "version", "lat", "lng").join(targets, ["session_id", "version"]))
            plans = plans.with_more(answered)
            fresh = asked.join(answered.totals.select("session_id", "version"), ["session_id", "version"])
            fresh = _recorded(fresh.withColumns({"point_index": F.lit(0).cast("bigint"), "dist_m": F.lit(None).cast("double")}), answered)
            kept = done.filter("kind = 'reroute'").join(answered.totals.select("session_id").distinct(), "session_id", "left_anti")
            told = done.filter("kind = 'guidance'").unionByName(fresh, allowMissingColumns=True)
            silent = done.filter("kind = 'arrived'").unionByName(kept).select("session_id", "fix_id", "ts", "us", "lat", "lng", "kind", "version", "verified")
            told = told.unionByName(silent, allowMissingColumns=True)
            written.append(cut(told, "told"))
            # a request ends the streak, whether it was answered or not
            switched = written[-1].filter("kind = 'reroute'").select("session_id", F.col("version").alias("newer"))
            active = active.join(switched, "session_id", "left").select(
                "session_id", F.coalesce("newer", "version").alias("version"),
                F.when(F.col("newer").isNotNull(), 0).otherwise(F.col("off")).alias("off"), "last_us",
            )
            active = cut(active, "active")
            rest = cut(rest.join(stops.filter("NOT arrived"), "session_id").filter(_at() > F.col("stop")).drop("stop", "arrived"), "rest")
        self._write(batch, sessions, active, written, plans)

    def _write(self, batch: int, sessions: DataFrame, active: DataFrame, written: list[DataFrame], plans: Plans) -> None:
        columns = [c.split()[0] for c in GUIDED.split(", ")]
        told = None
        for part in written:
            told = part if told is None else told.unionByName(part, allowMissingColumns=True)
        if told is None:
            told = self.spark.createDataFrame([], GUIDED).withColumns({c: F.lit(None).cast("double") for c in ("verified", "lat", "lng")})
            told = told.withColumn("us", F.lit(None).cast("bigint"))
        out = told.withColumn("heading", F.col("verified")).select(*columns)
        out.write.mode("overwrite").parquet(f"{self.folder}/guided/batch={batch}")
        # off counts from the end: consecutive fixes off the route at the end of a session, after its last request
        off = (F.col("kind") == "guidance") & (F.coalesce("dist_m", F.lit(0.0)) > fx.OFF_ROUTE_M)
        last = told.groupBy("session_id").agg(
            F.max_by(F.struct("lat", "lng", "verified", "us"), _at()).alias("l"),
            F.max(F.col("kind") == "arrived").alias("now_arrived"),
            F.max_by(F.when(off, 1).otherwise(0), _at()).alias("now_off"),
        )
        joined = sessions.drop("version", "off").join(active.select("session_id", "version", F.col("off").alias("was_off")), "session_id")
        after = joined.join(last, "session_id", "left").select(
            "session_id",
            "version",
            F.coalesce("now_off", "was_off").cast("int").alias("off"),
            (F.col("arrived") | F.coalesce("now_arrived", F.lit(False))).alias("arrived"),
            F.coalesce("l.lat", "last_lat").alias("last_lat"),
            F.coalesce("l.lng", "last_lng").alias("last_lng"),
            F.coalesce("l.verified", "heading").alias("heading"),
            F.coalesce("l.us", "last_us").alias("last_us"),
        )
        after.write.mode("overwrite").parquet(f"{self.folder}/sessions/batch={batch}")
        for name in ("points", "steps", "totals"):
            getattr(plans, name).write.mode("overwrite").parquet(f"{self.folder}/plans/batch={batch}/{name}")


def straight_lines(requests: DataFrame) -> Plans:
    """Plans that lead straight to the destination, at walking pace; for places without roads."""
    keys = ["session_id", "version"]
    ends = F.posexplode(F.array(F.struct("lat", "lng"), F.struct(F.col("dest_lat").alias("lat"), F.col("dest_lng").alias("lng")))).alias("pos", "p")
    points = requests.select(*keys, ends).select(*keys, F.col("pos").cast("bigint").alias("pos"), "p.lat", "p.lng")
    names = F.posexplode(F.array(F.lit("depart"), F.lit("arrive"))).alias("step", "type")
    steps = requests.select(*keys, names).select(
        *keys, F.col("step").cast("bigint").alias("step"), F.col("step").cast("bigint").alias("at"), "type", F.lit(None).cast("string").alias("name")
    )
    metres = geo.haversine_m("lat", "lng", "dest_lat", "dest_lng")
    return Plans.of(points, steps, requests.select(*keys, (metres / fx.HEADING_MIN_SPEED_MS).alias("duration_s"), "dest_lat", "dest_lng"))


def road_plans(network) -> Callable[[DataFrame], Plans]:
    """An answer to requests by ``compute_routes``; network(requests) gives its RouteTables."""

    def answer(requests: DataFrame) -> Plans:
        keys = ["session_id", "version"]
        ids = cut(requests.withColumn("od_id", F.monotonically_increasing_id()), "requests")
        tables = network(
            ids.select("od_id", F.col("lat").alias("from_lat"), F.col("lng").alias("from_lng"), F.col("dest_lat").alias("to_lat"), F.col("dest_lng").alias("to_lng"))
        )
        named = lambda df: df.join(ids.select("od_id", *keys), "od_id")
        found = named(tables.summary.filter("reason IS NULL").select("od_id", "duration_s"))
        totals = found.join(requests.select(*keys, "dest_lat", "dest_lng"), keys)
        return Plans.of(named(tables.points), named(tables.steps), totals)

    return answer
