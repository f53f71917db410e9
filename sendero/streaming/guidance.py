"""Live guidance: each GPS fix against the route of its session.

Matching, remaining distance, next manoeuvre and ETA depend on one fix and its route only, so
they are plain columns of a stream-static join. State holds just what needs earlier fixes:
arrival, the off-route count and the last verified heading.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed_values as fx
from ..functions import geo, guidance
from ..operators.routes import measured_points, segments_of_line, with_nearest

STATE = T.StructType(
    [
        T.StructField("off_route", T.IntegerType()),
        T.StructField("arrived", T.BooleanType()),
        T.StructField("last_lat", T.DoubleType()),
        T.StructField("last_lng", T.DoubleType()),
        T.StructField("heading", T.DoubleType()),
        T.StructField("last_us", T.LongType()),
    ]
)
OUTPUT = (
    "session_id bigint, fix_id bigint, ts timestamp, kind string, heading double, dist_m double, "
    "point_index bigint, remaining_m double, step_dist_m double, step_type string, step_name string, eta_s double, label string"
)
GUIDE = ["dist_m", "point_index", "remaining_m", "step_dist_m", "step_type", "step_name", "eta_s", "label"]


def route_table(points: DataFrame, steps: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per session: line, running distances and steps of its active route.

    points(session_id, pos, lat, lng), steps(session_id, step, at, type, name),
    totals(session_id, duration_s, dest_lat, dest_lng). A row holds one route's line, which a
    phone loads as a whole too.
    """
    measured = measured_points(points.select("session_id", "pos", "lat", "lng"), ["session_id"])
    line = F.array_sort(F.collect_list(F.struct("pos", "lat", "lng", "cum_m")))
    listed = F.array_sort(F.collect_list(F.struct("step", "at", "type", "name")))
    lines = measured.groupBy("session_id").agg(line.alias("line"))
    turns = steps.groupBy("session_id").agg(listed.alias("steps"))
    return lines.join(turns, "session_id", "left").join(totals, "session_id")


def matched_fixes(fixes: DataFrame, routes: DataFrame) -> DataFrame:
    """Valid fixes with everything of a guidance record that needs no state."""
    valid = fixes.filter(geo.valid_coords("lat", "lng"))
    joined = valid.join(routes, "session_id")
    joined = with_nearest(joined, segments_of_line(F.col("line")))
    total = F.element_at("line", -1)["cum_m"]
    done = F.element_at("line", F.col("point_index").cast("int") + 1)["cum_m"]
    joined = joined.withColumns(
        {
            "dest_m": geo.haversine_m("lat", "lng", "dest_lat", "dest_lng"),
            "done_m": done,
            "remaining_m": F.greatest(F.lit(0.0), total - done),
            "next": guidance.upcoming_step("steps", "point_index"),
            "turns": F.coalesce(guidance.pending_turns("steps", "point_index"), F.lit(0)),
        }
    )
    raw = guidance.raw_eta_s("duration_s", "remaining_m", total)
    reach = F.element_at("line", F.least(F.col("next.at").cast("int") + 1, F.size("line")))["cum_m"]
    step_type = F.coalesce("next.type", F.lit("straight"))
    return joined.select(
        "session_id",
        "fix_id",
        "ts",
        F.unix_micros("ts").alias("us"),
        "lat",
        "lng",
        "speed",
        F.col("heading").alias("course"),
        "dest_m",
        "dist_m",
        "point_index",
        "remaining_m",
        F.coalesce(F.greatest(F.lit(0.0), reach - F.col("done_m")), F.col("remaining_m")).alias("step_dist_m"),
        step_type.alias("step_type"),
        F.col("next.name").alias("step_name"),
        guidance.eta_s(raw, "turns").alias("eta_s"),
        guidance.maneuver_label(step_type, "next.name").alias("label"),
    )


def _metres(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    s1 = math.sin(math.radians(lat2 - lat1) / 2)
    s2 = math.sin(math.radians(lng2 - lng1) / 2)
    h = s1 * s1 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * s2 * s2
    return 2 * fx.EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def _course(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    a, b, d = math.radians(lat1), math.radians(lat2), math.radians(lng2 - lng1)
    east = math.sin(d) * math.cos(b)
    north = math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d)
    return math.degrees(math.atan2(east, north)) % 360


def _missing(value) -> bool:
    return value is None or value != value


class GuidanceProcessor(StatefulProcessor):
    """Arrival, off-route requests and verified heading of each session.

    Fixes are taken in time order within a batch; one not later than the last seen is ignored.
    The state of a session that stays silent for ``ttl_ms`` is dropped. With ``idle_ms`` time is that of the fixes:
    a session whose last fix is that far behind the watermark, arrived or not, gives a row of kind ``expired`` and its state is released, and
    fixes that come too late for their session are not ignored but given as rows of kind ``late``.
    """

    def __init__(self, ttl_ms: int | None = None, idle_ms: int | None = None):
        self.ttl_ms = ttl_ms
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE, self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.session.get()
        if last is None:
            return
        self.session.clear()
        yield _row(key[0], None, datetime.fromtimestamp(last[5] // 1_000_000) + timedelta(microseconds=last[5] % 1_000_000), "expired", last[4])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.session.get() or (0, False, None, None, None, None)
        off, arrived, last_lat, last_lng, heading, last_us = state
        timer = last_us
        for fix in sorted(rows, key=lambda r: (r.us, r.fix_id)):
            if last_us is not None and fix.us <= last_us:
                if self.idle_ms:
                    yield _row(key[0], fix.fix_id, fix.ts, "late", heading)
                continue
            last_us = fix.us
            if arrived:
                continue
            moving = _missing(fix.speed) or fix.speed >= fx.HEADING_MIN_SPEED_MS
            if moving and not _missing(fix.course):
                heading = float(fix.course)
            elif moving and last_lat is not None:
                if _metres(last_lat, last_lng, fix.lat, fix.lng) >= fx.HEADING_MIN_MOVE_M:
                    heading = _course(last_lat, last_lng, fix.lat, fix.lng)
            last_lat, last_lng = float(fix.lat), float(fix.lng)
            if fix.dest_m <= fx.ARRIVE_M:
                arrived = True
                kind = "arrived"
            else:
                off = off + 1 if fix.dist_m > fx.OFF_ROUTE_M else 0
                kind = "guidance"
                if off >= fx.OFF_ROUTE_FIXES:
                    off, kind = 0, "reroute"
            yield _row(key[0], fix.fix_id, fix.ts, kind, heading, fix if kind == "guidance" else None)
        if last_us == timer:
            return
        self.session.update((off, arrived, last_lat, last_lng, heading, last_us))
        if self.idle_ms:
            if timer is not None:
                self.handle.deleteTimer(timer // 1000 + self.idle_ms)
            self.handle.registerTimer(last_us // 1000 + self.idle_ms)

    def close(self) -> None:
        pass


def _row(session_id: int, fix_id: int | None, ts: datetime, kind: str, heading: float | None, fix: Row | None = None) -> Row:
    told = {c: fix[c] if fix else None for c in GUIDE}
    return Row(session_id=session_id, fix_id=fix_id, ts=ts, kind=kind, heading=heading, **told)


def guide(
    fixes: DataFrame, routes: DataFrame, ttl_ms: int | None = None, idle_ms: int | None = None, lateness: str | None = None
) -> DataFrame:
    """Guidance records of a stream of fixes: kind is guidance, reroute or arrived.

    A reroute row carries no guidance: it asks the routing job for a new route, from whose first
    point the session goes on. After arrival a session gives nothing more.

    Give ``ttl_ms`` to a stream that runs for good. A processing-time state keeps asking for
    batches, so a stream that should end by itself (availableNow) goes without. With ``idle_ms`` sessions
    expire by the time of the fixes instead; the watermark stays ``lateness`` behind the newest fix, and
    what is older than the watermark was before the last batch is not taken at all.
    """
    if idle_ms:
        fixes = fixes.withWatermark("ts", lateness or "0 seconds")
    return (
        matched_fixes(fixes, routes)
        .groupBy("session_id")
        .transformWithState(
            statefulProcessor=GuidanceProcessor(ttl_ms, idle_ms),
            outputStructType=OUTPUT,
            outputMode="Append" if idle_ms else "Update",
            timeMode="EventTime" if idle_ms else "ProcessingTime" if ttl_ms else "None",
        )
    )
