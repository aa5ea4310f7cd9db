"""Queries of the trip operators over the real pings, stops and terminals, and of both extractions as users call them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..evaluation.anchors import anchor_detection, stop_association
from ..evaluation.sufficiency import make_splits
from ..operators import features
from ..operators import pings as P
from ..operators.cleaning import blank, clean_pings
from ..operators.diagnostics import diagnostics
from ..operators.matching import radius_match
from ..operators.segmentation import by_terminals
from ..operators.sequence import keyed
from ..operators.sequence import session_ids as number_sessions
from ..operators.shapes import shapes_from_trips
from ..operators.timestamps import normalise
from ..operators.tracks import valid_position
from ..shared import stage
from ..sources.feed import lines_from_wkt
from ..sources.tables import table
from . import events_pings as E
from .gps_sql import ORACLE
from .pipeline import Cut, Options, cut_trips, extract_trips, extract_trips_and_stop_times

GAP_US = 14_400_000_000
TERMINAL_M, STOP_M, STOP_WIDE_M = 250.0, 50.0, 150.0


def _written(spark: SparkSession, d: str) -> DataFrame:
    """All pings with a readable time and coordinates in range, as the cleaning operator wants them."""
    rows = normalise(table(spark, d, "gps_data"), table(spark, d, "feeds"), "vehicle_id", "latitude", "longitude", "speed")
    ok = F.col("instant_us").isNotNull() & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    return rows.where(ok).withColumn("timestamp", F.timestamp_micros("instant_us")).drop("instant_us", "canonical")


def gps_clean(spark: SparkSession, d: str) -> DataFrame:
    """Zero coordinates, blank vehicles and repeats dropped, with all checks."""
    return clean_pings(_written(spark, d), order_col="id").pings.select("id", "vehicle_id", "t", "latitude", "speed", "date", "time_str")


def _pings(spark: SparkSession, d: str) -> DataFrame:
    """Kept rows with a position; way is the direction by its letters and digits."""
    rows = P.kept_rows(table(spark, d, "gps_data"), table(spark, d, "feeds"), "latitude", "longitude", "speed", "direction", "trip_id", "route_id").where(valid_position())
    way = F.nullif(F.regexp_replace(F.lower("direction"), r"[^\p{L}\p{N}]", ""), F.lit(""))
    return rows.select("id", "vehicle_id", F.timestamp_micros("t").alias("timestamp"), "latitude", "longitude", "speed", F.col("trip_id").alias("trip_key"), "route_id", way.alias("way"))


def gps_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the pings with a position."""
    return number_sessions(clean_pings(_pings(spark, d)).pings, GAP_US).select("id", "session_id")


def _by_trip(spark: SparkSession, d: str) -> Cut:
    return cut_trips(spark, _pings(spark, d), None, Options(trip_col="trip_key", direction_col="way", cut_on_direction_change=True))


def _shape(trips: DataFrame) -> DataFrame:
    columns = ["trip_id", "vehicle_id", "date", "start_terminal", "end_terminal", "direction", "start_us", "end_us", "provided_trip_id", "duration_in_mins", "day_of_week", "hour_of_day", "is_weekday"]
    return trips.select(*columns).withColumn("duration_in_mins", F.round("duration_in_mins", 9))


def gps_trips_by_identity(spark: SparkSession, d: str) -> DataFrame:
    """Trips as annotated, cut where the direction changes for good."""
    return _shape(_by_trip(spark, d).trips)


def _terminals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "terminals_data").where(~blank(F.col("terminal_id")))


def gps_trips_by_terminals(spark: SparkSession, d: str) -> DataFrame:
    """Trips from one terminal to another."""
    rows = stage(keyed(clean_pings(_pings(spark, d)).pings, GAP_US), "keyed")
    return by_terminals(rows, _terminals(spark, d), TERMINAL_M, GAP_US).trips.select("vehicle_id", "start_us", "end_us", "start_terminal", "end_terminal")


def gps_trips_by_layover(spark: SparkSession, d: str) -> DataFrame:
    """Trips between layovers, their ends named by the nearest terminal."""
    return _shape(cut_trips(spark, _pings(spark, d), _terminals(spark, d), Options(segmentation="layover")).trips)


def _path(spark: SparkSession, d: str) -> tuple[Cut, DataFrame, DataFrame]:
    cut = _by_trip(spark, d)
    trips = stage(cut.trips, "trips")
    return cut, trips, features.trajectory(cut.pings, trips)


def gps_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """Pings with the annotated trips that they lie in."""
    return _path(spark, d)[2].select("id", "trip_id", "direction")


def _stops(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "stops_data").where(~blank(F.col("stop_id")) & F.col("route_id").isNotNull())
    return s.select("stop_id", "latitude", "longitude", "ord", F.col("route_id").alias("direction"))


def gps_stop_matches(spark: SparkSession, d: str) -> DataFrame:
    """The first stop of the ping's route within 50 m, else within 150 m."""
    rows = _pings(spark, d).withColumn("direction", F.col("route_id"))
    return radius_match(rows, _stops(spark, d), "stop_id", STOP_M, STOP_WIDE_M, by="direction", name="stop_id").select("id", "stop_id")


def _visits(path: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return features.stop_visits(path.withColumn("direction", F.col("route_id")), _stops(spark, d), STOP_M, STOP_WIDE_M)


def gps_stop_visits(spark: SparkSession, d: str) -> DataFrame:
    """Visits of stops of their route by annotated trips."""
    v = _visits(_path(spark, d)[2], spark, d)
    return v.select("trip_id", "vehicle_id", "date", "direction", "stop_id", "arrival_us", "departure_us", "dwell_time_in_seconds", "day_of_week", "hour_of_day", "is_weekday")


def gps_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Driven shapes of annotated trips."""
    return shapes_from_trips(_path(spark, d)[2]).withColumn("shape_dist_traveled", F.round("shape_dist_traveled", 3))


def gps_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What survived each stage of the annotated trips."""
    cut, trips, path = _path(spark, d)
    path = stage(path, "trajectory")
    return diagnostics(cut.counts, cut.drops, trips, path, _visits(path, spark, d))


def _micros(df: DataFrame) -> DataFrame:
    """Times as micros, so that they compare whatever the zone of a session."""
    for c, kind in df.dtypes:
        if kind.startswith("timestamp"):
            df = df.withColumn(c, F.unix_micros(c))
    return df.withColumn("duration_in_mins", F.round("duration_in_mins", 9)) if "duration_in_mins" in df.columns else df


_OPTIONS = {"terminals_buffer_radius": 100.0, "session_gap": 3 * 86_400}


def extraction_trips(spark: SparkSession, d: str) -> DataFrame:
    """The trips of an extraction of trips only, all columns."""
    return _micros(extract_trips(spark, E.pings(spark, d), E.terminals(spark), Options(**_OPTIONS)).trips)


def extraction_stop_times(spark: SparkSession, d: str) -> DataFrame:
    """The stop times of an extraction of trips and stop times, all columns."""
    out = extract_trips_and_stop_times(spark, E.pings(spark, d), E.stops(spark), E.terminals(spark), stops_buffer_radius=50.0, stops_extended_buffer_radius=150.0, options=Options(**_OPTIONS))
    return _micros(out.stop_times)


def extraction_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What survived each stage of that extraction."""
    pings = E.pings(spark, d).withColumn("vehicle_id", F.col("vehicle_id").cast("string"))
    out = extract_trips_and_stop_times(spark, pings, E.stops(spark), E.terminals(spark), stops_buffer_radius=50.0, stops_extended_buffer_radius=150.0, options=Options(**_OPTIONS))
    return out.diagnostics


def stop_association_query(spark: SparkSession, d: str) -> DataFrame:
    """The nearest stop of every row of terminals, named if it is within 100 m."""
    places = table(spark, d, "terminals_data").withColumn("anchor", F.col("ord"))
    stops = table(spark, d, "stops_data").where("stop_id is not null")
    return stop_association(places, stops).select("anchor", "stop_id", F.round("distance_m", 3).alias("distance_m"), "matched")


def anchor_scores(spark: SparkSession, d: str) -> DataFrame:
    """Terminals as discovered anchors against stops as audited ones."""
    at = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    found = table(spark, d, "terminals_data").where(at).select(F.col("ord").alias("anchor"), "latitude", "longitude", (F.col("ord") % 7).alias("recurrence"), F.lit(0.5).alias("coverage"))
    truth = table(spark, d, "stops_data").where(at).select(F.col("ord").alias("anchor"), "latitude", "longitude")
    score = anchor_detection(found, truth)
    return spark.createDataFrame([(score.n_discovered_kept, score.n_truth, score.n_dropped_low_support, score.splits, score.merges)], "n_kept int, n_truth int, n_dropped int, splits int, merges int")


def lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Vertices of the route lines, written as geometries and read again."""
    v = table(spark, d, "route_lines").where("latitude is not null and longitude is not null and vertex_seq is not null and route_id is not null and direction is not null").distinct()
    points = F.sort_array(F.collect_list(F.struct("vertex_seq", "latitude", "longitude")))
    lines = v.groupBy("route_id", "direction").agg(points.alias("p"))
    text = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("p", lambda x: F.concat_ws(" ", x["longitude"].cast("string"), x["latitude"].cast("string"))), ", "), F.lit(")"))
    return lines_from_wkt(lines.select("route_id", "direction", text.alias("geometry"))).withColumn("vertex_seq", F.col("vertex_seq").cast("bigint"))


def projected_matches(spark: SparkSession, d: str) -> DataFrame:
    """The first terminal within 250 m of a ping, in coordinates of a plane."""
    plane = lambda df: df.withColumns({"latitude": F.col("latitude") * 111_195.0, "longitude": F.col("longitude") * 70_000.0})
    return radius_match(plane(_pings(spark, d)), plane(_terminals(spark, d)), "terminal_id", TERMINAL_M, name="terminal_id", projected=True).select("id", "terminal_id")


def evaluation_splits(spark: SparkSession, d: str) -> DataFrame:
    """Events of two groups parted into calibration, held-out and transfer data."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("a"), F.col("user_id") % 3).alias("agency"), (F.col("user_id") % 4).alias("period"))
    parts = make_splits(e, "a0", "a1", "period", [0, 1])
    named = [df.select(F.lit(n).alias("part")) for n, df in (("calibration", parts.calibration), ("heldout", parts.heldout), ("transfer", parts.transfer))]
    return named[0].unionByName(named[1]).unionByName(named[2]).groupBy("part").agg(F.count("*").alias("n"))


_ALL = (
    gps_clean, gps_sessions, gps_trips_by_identity, gps_trips_by_terminals, gps_trips_by_layover, gps_trajectory, gps_stop_matches, gps_stop_visits, gps_shapes, gps_diagnostics,
    extraction_trips, extraction_stop_times, extraction_diagnostics, anchor_scores, lines_round_trip, projected_matches, evaluation_splits,
)
QUERIES = {f.__name__: f for f in _ALL} | {"stop_association": stop_association_query}

__all__ = ["ORACLE", "QUERIES"]
