"""Queries of the trip operators over pings derived from events, and over route lines, stops and terminals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..evaluation import matching as M
from ..evaluation import metrics, orientation, sufficiency
from ..operators import builders, features
from ..operators.cleaning import clean_pings
from ..operators.diagnostics import diagnostics as build_diagnostics
from ..operators.dwell import dwell_runs as find_dwells
from ..operators.matching import nearest, radius_match
from ..operators.sequence import in_order, keyed, with_runs
from ..operators.sequence import session_ids as number_sessions
from ..operators.shapes import shapes_from_trips
from ..shared import stage
from ..sources.tables import table
from . import events_pings as E
from .pipeline import Cut, Options, cut_trips, stop_levels
from .reference_sql import ORACLE

DAY = 86_400
GAP_S = 3 * DAY
GAP = GAP_S * 1_000_000
LAYOVER = {"session_gap": 2 * DAY, "layover_gap": 20 * 3600, "layover_radius": 300.0}
TRIP = ["trip_id", "vehicle_id", "date", "start_terminal", "end_terminal", "direction", "start_us", "end_us", "provided_trip_id", "duration_in_mins", "day_of_week", "hour_of_day", "is_weekday"]


def _shape(trips: DataFrame) -> DataFrame:
    return trips.select(*[F.round(c, 9).alias(c) if c == "duration_in_mins" else F.col(c) for c in TRIP])


def _cut(spark: SparkSession, d: str, layover: bool = False, **options: object) -> Cut:
    o = Options(**({"session_gap": GAP_S} | options))
    return cut_trips(spark, E.pings(spark, d, layover), E.terminals(spark), o)


def _identity(spark: SparkSession, d: str) -> Cut:
    return _cut(spark, d, trip_col="trip_key")


def _terminals(spark: SparkSession, d: str, radius: float = 100.0) -> Cut:
    return _cut(spark, d, terminals_buffer_radius=radius, segmentation="terminals")


def _layover(spark: SparkSession, d: str) -> Cut:
    return _cut(spark, d, True, segmentation="layover", **LAYOVER)


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return keyed(clean_pings(E.pings(spark, d)).pings, GAP)


def clean_pings_query(spark: SparkSession, d: str) -> DataFrame:
    """Zero coordinates, blank vehicles and repeats dropped; date and clock texts."""
    return clean_pings(E.dirty_pings(spark, d)).pings.select("id", "vehicle_id", "t", "latitude", "speed", "date", "time_str")


def session_ids(spark: SparkSession, d: str) -> DataFrame:
    """Session numbers by silences over three days."""
    return number_sessions(clean_pings(E.pings(spark, d)).pings, GAP).select("id", "vehicle_id", "session_id")


def run_ids(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one direction in each session."""
    return with_runs(_keyed(spark, d), "run", F.col("dir_noisy"), in_order()).select("id", F.col("_s").alias("session_us"), "run")


def trips_by_identity(spark: SparkSession, d: str) -> DataFrame:
    """Trips by a supplied identity, missing on some pings."""
    return _shape(_identity(spark, d).trips)


def trips_by_identity_composite(spark: SparkSession, d: str) -> DataFrame:
    """Trips by an identity of two columns."""
    return _shape(_cut(spark, d, trip_col=["trip_key", "dir_flag"]).trips)


def trips_debounced(spark: SparkSession, d: str) -> DataFrame:
    """Trips cut where the direction changes for good."""
    return _shape(_cut(spark, d, trip_col="trip_key", direction_col="dir_noisy", cut_on_direction_change=True).trips)


def trips_by_terminals(spark: SparkSession, d: str) -> DataFrame:
    """Trips between terminals of radius 100 m."""
    return _shape(_terminals(spark, d).trips)


def trips_by_terminals_tight(spark: SparkSession, d: str) -> DataFrame:
    """Radius 60 m: one ping a stay, so that pairs compete."""
    return _shape(_terminals(spark, d, 60.0).trips)


def _dwells(spark: SparkSession, d: str) -> DataFrame:
    return keyed(clean_pings(E.pings(spark, d, True)).pings, LAYOVER["session_gap"] * 1_000_000)


def dwell_runs(spark: SparkSession, d: str) -> DataFrame:
    """Stationary runs of radius 300 m."""
    return find_dwells(_dwells(spark, d), LAYOVER["layover_radius"]).select("id", F.col("_s").alias("session_us"), "run")


def trips_by_layover(spark: SparkSession, d: str) -> DataFrame:
    """Trips between layovers of over 20 hours."""
    return _shape(_layover(spark, d).trips)


def _path(cut: Cut) -> tuple[DataFrame, DataFrame]:
    trips = stage(cut.trips, "trips")
    return trips, features.trajectory(cut.pings, trips)


def trajectory(spark: SparkSession, d: str) -> DataFrame:
    """Pings with the trips between terminals that they lie in."""
    return _path(_terminals(spark, d))[1].select("id", "trip_id", "direction")


def _stops(spark: SparkSession) -> DataFrame:
    levels = stop_levels(["A", "B"], ["A", "B"], None)
    return E.stops(spark).withColumn("direction", features.level(F.col("direction"), sorted(levels, key=levels.get)))


def stop_matches(spark: SparkSession, d: str) -> DataFrame:
    """The first stop of the trip's direction within 50 m, else within 150 m."""
    path = _path(_terminals(spark, d))[1].where("trip_id is not null")
    return radius_match(path, _stops(spark), "stop_id", 50.0, 150.0, by="direction", name="stop_id").select("id", "stop_id")


def _visits(spark: SparkSession, d: str, min_dwell: float) -> DataFrame:
    trips, path = _path(_terminals(spark, d))
    v = features.stop_visits(path, _stops(spark), 50.0, 150.0, min_dwell, ["A", "B"])
    return v.select("trip_id", "vehicle_id", "date", "direction", "stop_id", "arrival_us", "departure_us", "dwell_time_in_seconds", "day_of_week", "hour_of_day", "is_weekday")


def stop_visits(spark: SparkSession, d: str) -> DataFrame:
    """Visits of stops by trips between terminals."""
    return _visits(spark, d, 0.0)


def stop_visits_min_dwell(spark: SparkSession, d: str) -> DataFrame:
    """Visits of at least 15 s."""
    return _visits(spark, d, 15.0)


def nearest_terminal(spark: SparkSession, d: str) -> DataFrame:
    """The nearest terminal of every row of stops."""
    rows = nearest(table(spark, d, "stops_data"), table(spark, d, "terminals_data"), "terminal_id", "latitude", "longitude", "terminal_id")
    return rows.select("ord", "stop_id", "terminal_id", F.round("terminal_id_m", 3).alias("metres"))


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """Driven shapes of trips by identity."""
    s = shapes_from_trips(_path(_identity(spark, d))[1])
    return s.withColumn("shape_dist_traveled", F.round("shape_dist_traveled", 3))


def _diagnosed(cut: Cut, visits: bool) -> DataFrame:
    trips, path = _path(cut)
    v = features.stop_visits(path, _stops(trips.sparkSession), 50.0, 150.0, 0.0, ["A", "B"]) if visits else None
    return build_diagnostics(cut.counts, cut.drops, trips, path, v)


def diagnostics_identity(spark: SparkSession, d: str) -> DataFrame:
    """What survived each stage, by identity."""
    return _diagnosed(_identity(spark, d), True)


def diagnostics_terminals(spark: SparkSession, d: str) -> DataFrame:
    """What survived each stage, between terminals."""
    return _diagnosed(_terminals(spark, d), True)


def diagnostics_layover(spark: SparkSession, d: str) -> DataFrame:
    """What survived each stage, between layovers."""
    return _diagnosed(_layover(spark, d), False)


def stops_from_positions(spark: SparkSession, d: str) -> DataFrame:
    """Median positions of the pings that stand at a place."""
    p = E.pings(spark, d).withColumns({"stop_id": F.concat(F.lit("S"), F.col("pos")), "current_status": F.when(F.col("speed") == 0, "STOPPED_AT").otherwise("IN_TRANSIT_TO")})
    out = builders.stops_from_positions(p)
    return out.select("stop_id", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"), "n_obs")


def terminals_from_feed(spark: SparkSession, d: str) -> DataFrame:
    """The two commonest ends of the route's trips."""
    return builders.terminals_from_feed(E.feed(spark, d), "r1")


def stops_from_feed(spark: SparkSession, d: str) -> DataFrame:
    """Stops by the terminal that trips start from."""
    return builders.stops_from_feed(E.feed(spark, d), "r1")


def terminals_from_lines(spark: SparkSession, d: str) -> DataFrame:
    """First vertices of the lines of all routes."""
    return builders.terminals_from_lines(table(spark, d, "route_lines"))


def stops_from_lines(spark: SparkSession, d: str) -> DataFrame:
    """Stops within 50 m of the lines of their route."""
    return builders.stops_from_lines(table(spark, d, "route_lines"), table(spark, d, "stops_data"))


def _segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Trips by identity as predictions, trips between terminals as truth."""
    def of(cut: Cut, tag: str) -> DataFrame:
        return stage(cut.trips.select(F.concat(F.lit(tag), F.col("trip_id")).alias("seg_id"), "vehicle_id", F.concat(F.lit("r"), F.col("vehicle_id") % 10).alias("route_id"), "start_us", "end_us"), "segments")

    return of(_cut(spark, d, trip_col=["trip_key", "dir_flag"]), "p"), of(_terminals(spark, d), "t")


def segment_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of predicted and true trips together."""
    return M.segment_sessions(*_segments(spark, d), 14_400_000_000)


def segment_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of predicted and true trips."""
    return M.overlaps(*_segments(spark, d), 14_400_000_000).select("pred_id", "truth_id", F.round("iou", 9).alias("iou"))


def segment_split_merge(spark: SparkSession, d: str) -> DataFrame:
    """How many true trips are split and predicted ones merge several."""
    return M.match_segments(*_segments(spark, d)).counts


def segment_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The matching of greatest total overlap."""
    return M.match_segments(*_segments(spark, d)).matches.withColumn("iou", F.round("iou", 9))


def segment_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the predicted trips."""
    return metrics.segment_metrics(*_segments(spark, d))


def segment_scores(spark: SparkSession, d: str) -> DataFrame:
    """The same without the bootstrap, whose draws only we can tell."""
    s = segment_metrics(spark, d).drop("f1_low", "f1_high")
    rounded = lambda c: F.round(c, 6 if c.startswith(("boundary", "unassigned")) else 9).alias(c)
    return s.select(*[rounded(c) if t == "double" else F.col(c) for c, t in s.dtypes])


def macro_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Scores averaged over routes."""
    pred, truth = _segments(spark, d)
    m = M.match_segments(pred, truth).matches
    out = metrics.macro_metrics(metrics.flagged(pred, truth, m, 0.5, None))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def _matched(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    wrong = F.when(e % 3 == 0, 1).otherwise(0)
    return table(spark, d, "events").select(
        "event_id", F.concat(F.lit("q"), F.col("user_id") % 7).alias("route_id"), F.when(e % 5 != 0, (e % 2 + wrong) % 2).cast("int").alias("pred_orientation"),
        (e % 2).cast("int").alias("truth_direction"), (e % 4 != 0).alias("clean"), F.when(e % 13 != 0, (e % 101) / 101.0).alias("pred_confidence"),
    )


def orientation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and accuracy of orientations."""
    m = _matched(spark, d)
    s = orientation.orientation_scores(m, m.count())
    return s.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Error against coverage, most confident first."""
    r = orientation.risk_coverage(_matched(spark, d), "event_id")
    return r.select("rank", F.round("coverage", 9).alias("coverage"), F.round("selective_error", 9).alias("selective_error"))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by confidence."""
    c = orientation.calibration(_matched(spark, d))
    return c.select("bin", "n", *[F.round(x, 9).alias(x) for x in ("mean_conf", "acc", "ece")])


def pattern_ari(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two labellings."""
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("group"))
    return metrics.pattern_ari(e, "event_type", "group").select(F.round("ari", 9).alias("ari"))


def _observed(spark: SparkSession, d: str) -> DataFrame:
    return E.pings(spark, d).withColumn("t", F.unix_micros("timestamp"))


def data_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pings suffice to judge anything."""
    s = sufficiency.data_sufficiency(_observed(spark, d), min_day_hours=2, min_pings=10)
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


def moving_segments(spark: SparkSession, d: str) -> DataFrame:
    """Runs of movement of each route."""
    return sufficiency.moving_segments(_observed(spark, d))


_ALL = (
    session_ids, run_ids, trips_by_identity, trips_by_identity_composite, trips_debounced, trips_by_terminals, trips_by_terminals_tight, dwell_runs, trips_by_layover, trajectory,
    stop_matches, stop_visits, stop_visits_min_dwell, nearest_terminal, shapes, diagnostics_identity, diagnostics_terminals, diagnostics_layover, stops_from_positions,
    terminals_from_feed, stops_from_feed, terminals_from_lines, stops_from_lines, segment_sessions, segment_iou, segment_split_merge, segment_assignment, segment_metrics, segment_scores,
    macro_metrics, orientation_scores, risk_coverage, calibration, pattern_ari, data_sufficiency, moving_segments,
)
QUERIES = {"clean_pings": clean_pings_query} | {f.__name__: f for f in _ALL}

__all__ = ["ORACLE", "QUERIES"]

