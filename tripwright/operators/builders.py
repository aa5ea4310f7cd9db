"""Terminals and stops from planned feeds, route lines, or annotated positions."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from .cleaning import blank, id_text
from .matching import line_distance

Feed = dict[str, DataFrame]
#: Terminals nearer to each other than this are likely two platforms of one place, metres.
SEPARATION_M = 150.0


def _ids(feed: Feed, name: str, columns: list[str]) -> DataFrame:
    if name not in feed:
        raise ValueError(f"the feed has no table {name}")
    df = feed[name]
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"{name} lacks the column {c}")
    return df.select(*[id_text(df, c).alias(c) if c.endswith("_id") else F.col(c) for c in columns])


def trip_endpoints(feed: Feed, route_id: str | int) -> DataFrame:
    """(trip_id, first_stop, last_stop) of the trips of a route, by numeric stop_sequence; ValueError for an unknown route."""
    trips = _ids(feed, "trips", ["trip_id", "route_id"])
    own = trips.where(F.col("route_id") == str(route_id))
    if own.isEmpty():
        some = [r[0] for r in trips.select("route_id").distinct().orderBy("route_id").limit(20).collect()]
        raise ValueError(f"route {route_id} is not in trips; there are {', '.join(map(str, some))}")
    times = _ids(feed, "stop_times", ["trip_id", "stop_id", "stop_sequence"]).join(own.select("trip_id").distinct(), "trip_id", "left_semi")
    n = F.col("stop_sequence").cast("double")
    return times.groupBy("trip_id").agg(F.min_by("stop_id", n).alias("first_stop"), F.max_by("stop_id", n).alias("last_stop"))


def terminals_from_feed(feed: Feed, route_id: str | int) -> DataFrame:
    """(terminal_id, latitude, longitude, ord): the two commonest ends of a route's trips, the commoner first.

    Of equally common ones the first in alphabet. Raises ValueError for a route with fewer than two ends or
    terminals without coordinates; warns where they cover under 90 % of ends or lie within SEPARATION_M.
    """
    ends = trip_endpoints(feed, route_id)
    counts = ends.select(F.explode(F.array("first_stop", "last_stop")).alias("terminal_id")).groupBy("terminal_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "terminal_id").limit(2).collect()
    if len(top) < 2:
        raise ValueError(f"route {route_id} has fewer than two ends; cut its trips at layovers instead")
    if sum(r.n for r in top) < 0.9 * total:
        warnings.warn("the two terminals cover under 90 % of the ends of trips; the route may have branches", stacklevel=2)
    spark = ends.sparkSession
    named = spark.createDataFrame([(r.terminal_id, i + 1) for i, r in enumerate(top)], "terminal_id string, ord int")
    stops = _ids(feed, "stops", ["stop_id", "stop_lat", "stop_lon"])
    out = named.join(stops, F.col("terminal_id") == F.col("stop_id")).select("terminal_id", F.col("stop_lat").cast("double").alias("latitude"), F.col("stop_lon").cast("double").alias("longitude"), "ord")
    places = out.collect()
    if len({r.terminal_id for r in places}) < 2:
        raise ValueError("terminals are missing from stops")
    near = out.alias("a").join(out.alias("b"), F.col("a.ord") < F.col("b.ord")).select(haversine_m(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude")).alias("m")).first()
    if near and near.m is not None and near.m < SEPARATION_M:
        warnings.warn(f"the two terminals are {near.m:.0f} m apart; they may be platforms of one place", stacklevel=2)
    return out.orderBy("ord")


def stops_from_feed(feed: Feed, route_id: str | int) -> DataFrame:
    """(stop_id, latitude, longitude, direction): stops of the trips that start at a terminal, labelled by it.

    Terminals are left out; so are trips that start elsewhere and stops without coordinates (with a warning).
    """
    terminals = [r.terminal_id for r in terminals_from_feed(feed, route_id).collect()]
    ends = trip_endpoints(feed, route_id)
    own = ends.where(F.col("first_stop").isin(terminals))
    all_, kept = ends.count(), own.count()
    if not kept:
        raise ValueError(f"no trip of route {route_id} starts at a terminal")
    if kept < all_:
        warnings.warn(f"{all_ - kept} of {all_} trips start at neither terminal and are left out", stacklevel=2)
    times = _ids(feed, "stop_times", ["trip_id", "stop_id", "stop_sequence"])
    pairs = times.join(own.select("trip_id", F.col("first_stop").alias("direction")), "trip_id").where(~F.col("stop_id").isin(terminals)).select("stop_id", "direction").distinct()
    stops = _ids(feed, "stops", ["stop_id", "stop_lat", "stop_lon"]).select("stop_id", F.col("stop_lat").cast("double").alias("latitude"), F.col("stop_lon").cast("double").alias("longitude"))
    lost = pairs.select("stop_id").distinct().join(stops, "stop_id", "left_anti").count()
    if lost:
        warnings.warn(f"{lost} stops of stop_times are not in stops and are left out", stacklevel=2)
    return pairs.join(stops, "stop_id").select("stop_id", "latitude", "longitude", "direction").orderBy("direction", "stop_id")


def checked_lines(lines: DataFrame, route_id: str | int) -> DataFrame:
    """Vertices (route_id, direction, vertex_seq, latitude, longitude) of one route; ValueError where it isn't usable."""
    for c in ("route_id", "direction", "vertex_seq", "latitude", "longitude"):
        if c not in lines.columns:
            raise ValueError(f"lines lack the column {c}")
    own = lines.where(id_text(lines, "route_id") == str(route_id))
    total, bad = own.agg(F.count("*"), F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull() | F.isnan("latitude") | F.isnan("longitude") | F.col("vertex_seq").isNull() | blank(F.col("direction")))).first()
    if not total:
        raise ValueError(f"route {route_id} has no line")
    if bad:
        raise ValueError(f"{bad} vertices of route {route_id} lack a coordinate, place or direction")
    if own.groupBy("direction").count().where("count < 2").count():
        raise ValueError(f"a direction of route {route_id} has fewer than two vertices")
    return own


def terminals_from_lines(lines: DataFrame) -> DataFrame:
    """(route_id, terminal_id, latitude, longitude, direction): the first vertex of each direction of each route.

    Vertices without coordinates or place are passed over; of several at the least place the southernmost.
    """
    ok = lines.where("latitude is not null and longitude is not null and vertex_seq is not null and route_id is not null and direction is not null")
    start = F.min(F.struct("vertex_seq", "latitude", "longitude"))
    out = ok.groupBy("route_id", "direction").agg(start.alias("s"))
    return out.select("route_id", F.col("direction").alias("terminal_id"), "s.latitude", "s.longitude", "direction")


def stops_from_lines(lines: DataFrame, stops: DataFrame, buffer_m: float = 50.0) -> DataFrame:
    """(route_id, stop_id, latitude, longitude, direction): stops within ``buffer_m`` of a direction's line.

    lines: vertices of any number of routes; stops: route_id, stop_id, latitude, longitude. A stop near both lines
    comes out for both. Blank ids, null coordinates and null routes take no part.
    """
    p = stops.where(~blank(F.col("stop_id")) & F.col("route_id").isNotNull()).select("route_id", id_text(stops, "stop_id").alias("stop_id"), "latitude", "longitude").distinct()
    p = p.withColumn("_k", F.struct("stop_id", "latitude", "longitude"))
    d = line_distance(p, lines, "_k").where(F.col("metres") <= buffer_m)
    return d.select("route_id", "_k.stop_id", "_k.latitude", "_k.longitude", "direction")


def route_terminals(lines: DataFrame, route_id: str | int) -> DataFrame:
    """(terminal_id, latitude, longitude, direction) of one route with exactly two directions; else ValueError."""
    out = terminals_from_lines(checked_lines(lines, route_id)).drop("route_id").orderBy("direction")
    got = out.collect()
    if len(got) != 2:
        raise ValueError(f"route {route_id} has {len(got)} directions, not two")
    return out


def route_stops(lines: DataFrame, stops: DataFrame, route_id: str | int, buffer_m: float = 50.0) -> DataFrame:
    """(stop_id, latitude, longitude, direction) of one route; warns if no stop is near its lines."""
    if not buffer_m > 0:
        raise ValueError("buffer_m must be positive")
    own = checked_lines(lines, route_id).withColumn("route_id", F.lit(str(route_id)))
    out = stops_from_lines(own, stops.withColumn("route_id", F.lit(str(route_id))), buffer_m).drop("route_id")
    if out.isEmpty():
        warnings.warn(f"no stop is within {buffer_m} m of route {route_id}", stacklevel=2)
    return out.orderBy("direction", "stop_id")


def stops_from_positions(positions: DataFrame, statuses: tuple[str, ...] = ("STOPPED_AT",), min_obs: int = 3) -> DataFrame:
    """(stop_id, latitude, longitude, n_obs): median position of the pings that name a stop.

    Where there is a current_status it must be one of ``statuses``. A stop with a null coordinate among its pings has
    a null median; stops with fewer than ``min_obs`` pings are left out.
    """
    if min_obs < 1:
        raise ValueError("min_obs must be positive")
    rows = positions.where(~blank(F.col("stop_id")))
    if "current_status" in positions.columns:
        rows = rows.where(F.col("current_status").isin(*statuses))
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.median(c)).alias(c)
    out = rows.groupBy(id_text(positions, "stop_id").alias("stop_id")).agg(whole("latitude"), whole("longitude"), F.count("*").alias("n_obs"))
    return out.where(F.col("n_obs") >= min_obs).orderBy("stop_id")

