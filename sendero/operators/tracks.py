"""Batch analysis of GPS fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fx

HOUR_S = 3600


def off_route_streaks(
    fixes: DataFrame,
    limit_m: float = fx.OFF_ROUTE_M,
    n: int = fx.OFF_ROUTE_FIXES,
    block_s: int = HOUR_S,
) -> DataFrame:
    """Adds streak and reroute to fixes(session_id, ts, fix_id, dist_m).

    streak counts consecutive fixes off the route; every n-th of them asks for a new route. The
    stream does the same one fix at a time. Here a session is cut into hours: windows count
    inside an hour, and the open streak at the end of each hour is carried over, so a session
    of any length is spread over many tasks.
    """
    off = (F.col("dist_m") > limit_m).cast("int")
    rows = fixes.withColumn("off", off).withColumn(
        "block", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (block_s * 1_000_000))
    )
    time = ["ts", "fix_id"]
    hour = W.partitionBy("session_id", "block").orderBy(*time)
    rows = rows.withColumn(
        "island", F.sum(1 - F.col("off")).over(hour.rowsBetween(W.unboundedPreceding, 0))
    )
    # one row per session, hour and island -> one row per session and hour
    islands = rows.groupBy("session_id", "block", "island").agg(F.sum("off").alias("run"))
    hours = islands.groupBy("session_id", "block").agg(
        (F.max("island") > 0).cast("int").alias("broken"), F.max_by("run", "island").alias("tail")
    )
    by_hour = W.partitionBy("session_id").orderBy("block")
    up_to = by_hour.rowsBetween(W.unboundedPreceding, 0)
    hours = hours.withColumn("chain", F.sum("broken").over(up_to))
    chained = W.partitionBy("session_id", "chain").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    hours = hours.withColumn("open", F.sum("tail").over(chained))
    hours = hours.withColumn("carry", F.coalesce(F.lag("open").over(by_hour), F.lit(0)))
    place = F.sum("off").over(
        W.partitionBy("session_id", "block", "island").orderBy(*time).rowsBetween(W.unboundedPreceding, 0)
    )
    joined = rows.join(hours.select("session_id", "block", "carry"), ["session_id", "block"])
    carry = F.when(F.col("island") == 0, F.col("carry")).otherwise(0)
    streak = F.when(F.col("off") == 1, place + carry).otherwise(0)
    return joined.withColumn("streak", streak).withColumn(
        "reroute", (F.col("streak") > 0) & (F.col("streak") % n == 0)
    ).drop("off", "block", "island", "carry")
