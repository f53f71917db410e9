import datetime
import os

import duckdb
from pyspark.sql import functions as F

from sendero.operators import tracks
from sendero.streaming.guidance import OUTPUT, guide, route_table
from tests import oracle
from workload import streams
from workload.streams import run_stream

START = datetime.datetime(2026, 1, 1)


def routes_for(spark, sessions):
    points = [(s, i, 38.0, -0.9 + 0.01 * i) for s in sessions for i in range(3)]
    p = spark.createDataFrame(points, "session_id bigint, pos bigint, lat double, lng double")
    steps = spark.createDataFrame(
        [(s, *x) for s in sessions for x in ((0, 0, "depart", "CV-1"), (1, 1, "left", "CV-2"), (2, 2, "arrive", None))],
        "session_id bigint, step bigint, at bigint, type string, name string",
    )
    totals = spark.createDataFrame([(s, 100.0, 38.0, -0.88) for s in sessions], "session_id bigint, duration_s double, dest_lat double, dest_lng double")
    return route_table(p, steps, totals)


FIX = "session_id bigint, ts timestamp, fix_id bigint, lat double, lng double, accuracy double, speed double, heading double"


def run(spark, tmp_path, batches, sessions):
    folder = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, FIX).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(FIX).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = run_stream(guide(stream, routes_for(spark, sessions)), OUTPUT)
    return out.orderBy("session_id", "ts").collect()


def fix(i, metres_off, lng=-0.895, speed=5.0, heading=None, session=1):
    return (session, START + datetime.timedelta(seconds=i), i, 38.0 + metres_off / 111320.0, lng, 5.0, speed, heading)


def test_off_route_sequence_over_batches(spark, tmp_path):
    offs = [40, 10, 40, 40, 40, 40, 5]
    rows = [fix(i, d) for i, d in enumerate(offs)]
    got = run(spark, tmp_path, [rows[:3], rows[3:5], rows[5:]], [1])
    assert [r.fix_id for r in got if r.kind == "reroute"] == [3, 5]
    assert [r.fix_id for r in got if r.kind == "guidance"] == [0, 1, 2, 4, 6]
    first = got[0]
    assert first.step_type == "left" and first.label == "Gira a la izquierda" and first.point_index == 0
    batch = tracks.off_route_streaks(spark.createDataFrame([(1, START + datetime.timedelta(hours=i), i, float(d)) for i, d in enumerate(offs)], "session_id bigint, ts timestamp, fix_id bigint, dist_m double"))
    assert sorted(r.fix_id for r in batch.filter("reroute").collect()) == [3, 5]


def test_arrival_heading_and_bad_fixes(spark, tmp_path):
    rows = [
        fix(0, 0, heading=90.0),
        fix(1, 0, lng=-0.894, speed=0.5, heading=10.0),
        fix(2, 0, lng=-0.893, speed=None),
        (1, START + datetime.timedelta(seconds=3), 3, None, -0.89, 1.0, None, None),
        fix(4, 0, lng=-0.8801),
        fix(5, 0, lng=-0.885),
        (1, START + datetime.timedelta(seconds=2), 9, 38.0, -0.885, 5.0, None, None),
    ]
    got = run(spark, tmp_path, [rows], [1])
    assert [(r.fix_id, r.kind) for r in got] == [(0, "guidance"), (1, "guidance"), (2, "guidance"), (4, "arrived")]
    assert got[0].heading == 90.0 and got[1].heading == 90.0 and abs(got[2].heading - 90.0) < 0.01
    assert got[3].dist_m is None and abs(got[2].remaining_m - 2 * 876.2) < 2


def test_a_session_asks_its_state_few_times_and_lists_no_timers():
    from datetime import datetime

    from pyspark.sql import Row

    from sendero.streaming.guidance import GUIDE, GuidanceProcessor

    asked = []

    class Known:
        value = None

        def getValueState(self, *_):
            return self

        def get(self):
            asked.append("get")
            return self.value

        def update(self, value):
            asked.append("update")
            self.value = value

        def registerTimer(self, ms):
            asked.append(("register", ms))

        def deleteTimer(self, ms):
            asked.append(("delete", ms))

    processor = GuidanceProcessor(idle_ms=1000)
    processor.init(Known())

    def fix(us, fix_id):
        told = dict.fromkeys(GUIDE) | {"dist_m": 1.0}
        return Row(fix_id=fix_id, ts=datetime(2024, 1, 1), us=us, speed=None, course=90.0, lat=38.0, lng=-0.9, dest_m=500.0, **told)

    out = [r.kind for us in (5_000_000, 7_000_000, 6_000_000) for r in processor.handleInputRows((1,), iter([fix(us, us)]), None)]
    assert out == ["guidance", "guidance", "late"]
    assert asked == ["get", "update", ("register", 6000), "get", "update", ("delete", 6000), ("register", 8000), "get"]


def test_loop_takes_fixes_of_equal_time_in_order_of_id(spark, tmp_path):
    given = "/root/testdata/sf0.001"
    hour = "date_trunc('hour', ts)"
    for name, ts in (("equal", hour), ("apart", f"{hour} + to_microseconds(event_id)")):
        folder = tmp_path / name
        folder.mkdir()
        for table in os.listdir(given):
            if table != "events.parquet":
                os.symlink(f"{given}/{table}", folder / table)
        duckdb.execute(f"COPY (SELECT * REPLACE ({ts} AS ts) FROM '{given}/events.parquet' WHERE event_id < 120) TO '{folder}/events.parquet'")
    key = "st03_reroute_loop"
    got = oracle.spark_rows(streams.QUERIES[key](spark, str(tmp_path / "equal")))
    assert got == oracle.duck_rows(oracle.connect(str(tmp_path / "apart")), streams.ORACLES[key])
