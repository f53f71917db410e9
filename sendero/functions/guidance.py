"""Columns of a guidance record: next step, pending turns, ETA and Spanish labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx
from .text import as_col, literal_map


def low_accuracy(accuracy: Column | str) -> Column:
    return F.coalesce(as_col(accuracy) > fx.LOW_ACCURACY_M, F.lit(False))


def upcoming_step(steps: Column | str, index: Column | str) -> Column:
    """First step after the departure at or beyond the point index, null if none."""
    index = as_col(index)
    ahead = F.filter(as_col(steps), lambda s: (s["type"] != "depart") & (s["at"] >= index))
    return F.try_element_at(ahead, F.lit(1))


def pending_turns(steps: Column | str, index: Column | str) -> Column:
    index = as_col(index)
    return F.size(
        F.filter(
            as_col(steps),
            lambda s: ~s["type"].isin("depart", "arrive") & (s["at"] >= index),
        )
    )


def raw_eta_s(duration_s, remaining_m, total_m) -> Column:
    duration_s, remaining_m, total_m = as_col(duration_s), as_col(remaining_m), as_col(total_m)
    share = F.when(total_m > 0, remaining_m / total_m)
    return F.coalesce(duration_s * share, F.lit(0.0))


def eta_s(raw_s: Column | str, turns: Column | str) -> Column:
    raw_s, turns = F.coalesce(as_col(raw_s), F.lit(0.0)), F.coalesce(as_col(turns), F.lit(0))
    return raw_s * fx.ETA_FACTOR + turns * fx.ETA_TURN_S


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def _text(c: Column) -> Column:
    return c.cast("string")


def _amount(c: Column | str) -> Column:
    c = as_col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (c < 0), F.lit(0.0)).otherwise(c)


def dist_label(metres: Column | str) -> Column:
    metres = _amount(metres)
    tenths = _half_up(metres / 100)
    whole, tenth = F.floor(tenths / 10), tenths % 10
    km = F.when(tenth == 0, _text(whole)).otherwise(
        F.concat(_text(whole), F.lit(","), _text(tenth))
    )
    return F.when(metres < 1000, F.concat(_text(_half_up(metres)), F.lit(" m"))).otherwise(
        F.concat(km, F.lit(" km"))
    )


def eta_label(seconds: Column | str) -> Column:
    seconds = _amount(seconds)
    minutes = _half_up(seconds / 60)
    hours, rest = F.floor(minutes / 60), minutes % 60
    return (
        F.when(seconds < 60, F.lit("menos de 1 min"))
        .when(minutes < 60, F.concat(_text(minutes), F.lit(" min")))
        .when(rest == 0, F.concat(_text(hours), F.lit(" h")))
        .otherwise(F.concat(_text(hours), F.lit(" h "), _text(rest), F.lit(" min")))
    )


def maneuver_label(kind: Column | str, road: Column | str) -> Column:
    kind, road = as_col(kind), as_col(road)
    follow = kind.isin("straight", "depart") & (F.coalesce(road, F.lit("")) != "")
    return F.when(follow, F.concat(F.lit("Sigue por "), road)).otherwise(
        F.coalesce(
            F.try_element_at(literal_map(fx.MANEUVER_TEXT), kind), F.lit(fx.MANEUVER_DEFAULT)
        )
    )
