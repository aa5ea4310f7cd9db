"""Trip and stop tables: features of trips, pings of trips, visits of stops."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleaning import RESERVED, local_text
from .matching import radius_match
from .sequence import KEY, in_order, numbered, up_to, with_runs

# Columns of the trip table and of the stop table, in order; label columns stay empty until a detector fills them.
TRIP_COLUMNS = [
    "trip_id", "vehicle_id", "date", "start_terminal", "end_terminal", "direction", "start_time", "end_time", "provided_trip_id",
    "duration_in_mins", "day_of_week", "hour_of_day", "is_weekday", "orientation_id", "orientation_status", "orientation_confidence",
    "pattern_ref", "start_anchor_ref", "end_anchor_ref",
]
STOP_COLUMNS = [
    "trip_id", "vehicle_id", "date", "direction", "stop_id", "arrival_time", "departure_time", "dwell_time_in_seconds", "day_of_week",
    "hour_of_day", "is_weekday", "provided_trip_id", "orientation_id", "orientation_status", "orientation_confidence", "pattern_ref",
]


def calendar(df: DataFrame, at: str, tz: str) -> DataFrame:
    """``df`` with date, day_of_week, hour_of_day and is_weekday of micros ``at`` on the clock of ``tz``."""
    df = df.withColumn("date", local_text(F.col(at), tz, "yyyy-MM-dd"))
    day = F.col("date").cast("date")
    names = F.array(*[F.lit(x) for x in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")])
    return df.withColumns({
        "day_of_week": F.get(names, F.weekday(day)), "hour_of_day": local_text(F.col(at), tz, "HH").cast("int"), "is_weekday": F.weekday(day) < 5,
    })


def labels(df: DataFrame, anchors: bool) -> DataFrame:
    """``df`` with the label columns in their empty state."""
    empty = {"orientation_id": F.lit(None).cast("int"), "orientation_status": F.lit("none"), "orientation_confidence": F.lit(None).cast("double"), "pattern_ref": F.lit(None).cast("string")}
    if anchors:
        empty |= {"start_anchor_ref": F.lit(None).cast("string"), "end_anchor_ref": F.lit(None).cast("string")}
    return df.withColumns(empty)


def level(value: Column, levels: list[str]) -> Column:
    """Place of ``value`` in ``levels``, from 1; null if it isn't one."""
    if not levels:
        return F.lit(None).cast("int")
    place = F.array_position(F.array(*map(F.lit, levels)), value.cast("string"))
    return F.when(place > 0, place.cast("int"))


def trip_features(trips: DataFrame, direction: Column, tz: str = "UTC") -> DataFrame:
    """The trip table from cut trips: numbered by vehicle and start, with minutes and the calendar of the start.

    Keeps start_us, end_us and _s beside TRIP_COLUMNS, for the operators that go on from trips.
    """
    for c in ("start_terminal", "end_terminal", "provided_trip_id"):
        if c not in trips.columns:
            trips = trips.withColumn(c, F.lit(None).cast("string"))
    rows = numbered(trips.withColumn("direction", direction))
    rows = rows.withColumns({
        "start_time": F.timestamp_micros("start_us"), "end_time": F.timestamp_micros("end_us"),
        "duration_in_mins": (F.col("end_us") - F.col("start_us")) / 60_000_000.0,
    })
    rows = labels(calendar(rows, "start_us", tz), True)
    return rows.select(*TRIP_COLUMNS, "start_us", "end_us", "_s")


def trajectory(pings: DataFrame, trips: DataFrame) -> DataFrame:
    """``pings`` with the trip_id and direction of the trip that each lies in, from its first ping to its last.

    Pings without identity in between belong to it; pings of no trip have null. Columns of RESERVED names are left out.
    """
    own = pings.drop(*RESERVED)
    marks = trips.select(*KEY, F.col("start_us").alias("t"), F.struct("trip_id", "direction", "end_us").alias("_m"))
    rows = own.join(marks, [*KEY, "t"], "left")
    # trips never overlap, so the last one begun is the only one that can hold a ping
    rows = rows.withColumn("_m", F.last("_m", ignorenulls=True).over(up_to(in_order())))
    inside = F.col("t") <= F.col("_m.end_us")
    return rows.withColumns({"trip_id": F.when(inside, F.col("_m.trip_id")), "direction": F.when(inside, F.col("_m.direction"))}).drop("_m")


def stop_visits(
    path: DataFrame, stops: DataFrame, r1: float, r2: float = 0.0, min_dwell: float = 0.0, leave_out: list[str] | None = None, tz: str = "UTC", projected: bool = False
) -> DataFrame:
    """One row for each visit of a stop by a trip.

    path: pings with trip_id and direction; stops: stop_id, direction (as in path), latitude, longitude, ord. A visit
    is a series of a trip's matched pings at one stop; unmatched pings vanish first. With pings at speed
    zero, arrival is the first of them, departure 15 s after the last, or the last ping in the buffer if
    that isn't later than 15 s after; else both are the first ping. Null speeds are never zero.
    """
    matched = radius_match(path.where("trip_id is not null"), stops, "stop_id", r1, r2, by="direction", name="stop_id", projected=projected).where("stop_id is not null")
    if leave_out:
        matched = matched.where(~F.col("stop_id").isin(leave_out))
    runs = with_runs(matched, "_g", F.col("stop_id"), in_order("trip_id"))
    zero = F.when(F.col("speed") == 0, F.col("t"))
    v = runs.groupBy(*KEY, "trip_id", "direction", "_g", "stop_id").agg(F.min(zero).alias("z1"), F.max(zero).alias("z2"), F.min("t").alias("a"), F.max("t").alias("b"))
    grace = F.lit(15_000_000)
    v = v.withColumn("arrival_us", F.coalesce("z1", "a"))
    leave = F.when(F.col("z1").isNull(), F.col("a")).when(F.col("b") - F.col("z2") > grace, F.col("z2") + grace).otherwise(F.col("b"))
    v = v.withColumn("departure_us", leave).withColumn("dwell_time_in_seconds", (F.col("departure_us") - F.col("arrival_us")) / 1_000_000.0)
    if min_dwell > 0:
        if matched.where("speed is not null").isEmpty():
            warnings.warn("no ping at a stop has a speed: every dwell is zero, and min_dwell leaves no visit", stacklevel=2)
        v = v.where(F.col("dwell_time_in_seconds") >= min_dwell)
    v = v.withColumns({"arrival_time": F.timestamp_micros("arrival_us"), "departure_time": F.timestamp_micros("departure_us")})
    return calendar(v, "arrival_us", tz).drop("z1", "z2", "a", "b", "_g")


def stop_times(visits: DataFrame, trips: DataFrame) -> DataFrame:
    """The stop table: visits with the labels of their trips."""
    meta = trips.select("trip_id", "provided_trip_id", "orientation_id", "orientation_status", "orientation_confidence", "pattern_ref")
    return visits.join(meta, "trip_id", "left").select(*STOP_COLUMNS)
