"""The two extractions: trips, and trips with stop times, from raw pings."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import segmentation as S
from ..operators.cleaning import blank, clean_pings, id_text, with_ids
from ..operators.diagnostics import diagnostics, warn_of_losses
from ..operators.features import level, stop_times, stop_visits, trajectory, trip_features
from ..operators.sequence import debounced, in_order, keyed, up_to
from ..shared import stage
from ..sources.tables import read, write


@dataclass
class Extract:
    """trips; stop_times and trajectory where asked for; diagnostics; whether coordinates are metres."""

    trips: DataFrame
    diagnostics: DataFrame
    projected: bool
    stop_times: DataFrame | None = None
    trajectory: DataFrame | None = None


@dataclass
class Options:
    """How trips are cut; times in seconds, distances in metres."""

    terminals_buffer_radius: float | None = None
    vehicle_col: str = "vehicle_id"
    time_col: str = "timestamp"
    tz: str | None = None
    projected: bool = False
    trip_col: str | list[str] | None = None
    direction_col: str | None = None
    cut_on_direction_change: bool = False
    direction_debounce_min_pings: int = 2
    direction_debounce_min_seconds: float = 600.0
    session_gap: float = 14_400.0
    segmentation: str = "auto"
    layover_gap: float = 600.0
    layover_radius: float = 50.0
    order_col: str | None = None
    validate: bool = True
    diagnostics_warn: bool = False

    def positive(self, name: str) -> None:
        v = getattr(self, name)
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v <= 0:
            raise ValueError(f"{name} must be one positive number")

    def mode(self, have_terminals: bool) -> str:
        """'identity', 'terminals' or 'layover', after checking that the options fit each other."""
        if self.segmentation not in ("auto", "terminals", "layover"):
            raise ValueError("segmentation must be auto, terminals or layover")
        self.positive("session_gap")
        if self.direction_col and not self.trip_col:
            raise ValueError("direction_col needs trip_col")
        if self.cut_on_direction_change and not self.direction_col:
            raise ValueError("cut_on_direction_change needs direction_col")
        if self.cut_on_direction_change and (self.direction_debounce_min_pings < 1 or self.direction_debounce_min_pings != int(self.direction_debounce_min_pings) or self.direction_debounce_min_seconds < 0):
            raise ValueError("the debounce thresholds must be a whole number of pings and seconds from zero")
        if self.trip_col:
            if self.segmentation != "auto":
                raise ValueError("segmentation cannot be chosen beside trip_col")
            return "identity"
        mode = self.segmentation if self.segmentation != "auto" else "terminals" if have_terminals else "layover"
        if mode == "terminals":
            if not have_terminals:
                raise ValueError("segmentation by terminals needs terminals")
            self.positive("terminals_buffer_radius")
        else:
            self.positive("layover_gap")
            self.positive("layover_radius")
            if self.layover_gap >= self.session_gap:
                warnings.warn("layover_gap is not below session_gap: no layover can cut", stacklevel=3)
        return mode


def _us(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def _places(spark: SparkSession, source: DataFrame | str, key: str) -> DataFrame:
    """Terminals or stops with text ids and ``ord``; without one, the order of ids."""
    df = read(spark, source)
    for c in (key, "latitude", "longitude"):
        if c not in df.columns:
            raise ValueError(f"the table of {key} lacks the column {c}")
    if df.where(blank(F.col(key))).limit(1).count():
        raise ValueError(f"{key} must not be blank")
    df = df.withColumn(key, id_text(df, key))
    return df if "ord" in df.columns else df.withColumn("ord", F.dense_rank().over(Window.orderBy(key)))




def terminal_ids(terminals: DataFrame) -> list[str]:
    """Distinct ids in table order; the direction of a trip is the place of its start terminal here."""
    return [r.terminal_id for r in terminals.groupBy("terminal_id").agg(F.min("ord").alias("o")).orderBy("o").collect()]


@dataclass
class Cut:
    """Cleaned keyed pings, the trip table, what cutting dropped, and the levels of direction."""

    pings: DataFrame
    counts: DataFrame
    trips: DataFrame
    drops: dict[str, DataFrame]
    levels: list[str] | None
    terminals: list[str]
    mode: str
    projected: bool


def _distinct(df: DataFrame, column: str) -> list[str]:
    return sorted(r[0] for r in df.where(~blank(F.col(column))).select(F.col(column).cast("string")).distinct().collect())


def cut_trips(spark: SparkSession, pings: DataFrame | str, terminals: DataFrame | str | None, o: Options, stop_labels: list[str] | None = None) -> Cut:
    """Clean, segment and describe trips, as both extractions do."""
    mode = o.mode(terminals is not None)
    cleaned = clean_pings(read(spark, pings), vehicle_col=o.vehicle_col, time_col=o.time_col, tz=o.tz, projected=o.projected, order_col=o.order_col, default_vehicle="veh_1" if o.trip_col else None, validate=o.validate, ids=False)
    places = _places(spark, terminals, "terminal_id") if terminals is not None else None
    ids = terminal_ids(places) if places is not None else []
    gap = _us(o.session_gap)
    rows = stage(keyed(cleaned.pings, gap), "keyed")  # cutting, trajectories and counts all read it
    counts = cleaned.counted(rows)
    rows = with_ids(rows)
    levels: list[str] | None = None
    first: Column
    if mode == "identity":
        columns = [o.trip_col] if isinstance(o.trip_col, str) else list(o.trip_col or [])
        if o.cut_on_direction_change:
            rows = debounced(rows, "_smooth", o.direction_col, o.direction_debounce_min_pings, o.direction_debounce_min_seconds)
            columns = [*columns, "_smooth"]
        found = S.by_identity(rows, columns, gap)
        trips = S.named_ends(found.trips, places, o.projected)
        if o.direction_col:
            value = "_smooth" if o.cut_on_direction_change else o.direction_col
            trips = with_direction(trips, rows, columns, value, gap)
            levels = sorted({*_distinct(rows, value), *(stop_labels or [])})
            first = level(F.col("_dir"), levels)
        else:
            first = level(F.col("start_terminal"), ids)
        drops = found.drops
    elif mode == "terminals":
        found = S.by_terminals(rows, places, o.terminals_buffer_radius, gap, o.projected)
        trips, drops, first = found.trips, {}, level(F.col("start_terminal"), ids)
    else:
        found = S.by_layover(rows, _us(o.layover_gap), o.layover_radius, places, o.projected)
        trips, drops, first = found.trips, found.drops, F.lit(1)
        levels = ["layover"]
    if levels is None and len(ids) != 2:
        raise ValueError("direction by start terminal needs exactly two terminals; pass direction_col, or cut at layovers")
    table = trip_features(trips, first, o.tz or "UTC")
    return Cut(rows, counts, table, drops, levels, ids, mode, cleaned.projected)


def with_direction(trips: DataFrame, rows: DataFrame, columns: list[str], value: str, gap_us: int) -> DataFrame:
    """``trips`` with _dir, the one direction of each; ValueError if a trip has several (blanks don't count)."""
    marks = trips.select("vehicle_id", "_s", F.col("start_us").alias("t"), F.struct("start_us", "end_us").alias("_m"))
    p = rows.where(~blank(S.identity(columns))).join(marks, ["vehicle_id", "_s", "t"], "left")
    p = p.withColumn("_m", F.last("_m", ignorenulls=True).over(up_to(in_order()))).where(F.col("t") <= F.col("_m.end_us"))
    p = p.withColumn("_v", F.when(~blank(F.col(value)), F.col(value).cast("string")))
    per = p.groupBy("vehicle_id", "_s", F.col("_m.start_us").alias("start_us")).agg(F.min("_v").alias("a"), F.max("_v").alias("b"), F.min_by(F.col("_v"), F.when(F.col("_v").isNotNull(), F.col("t"))).alias("_dir"), F.max("_m.end_us").alias("z"))
    changes = F.col("a") != F.col("b")
    bad, known, longest = per.agg(F.count_if(changes), F.count("a"), F.max(F.when(changes, (F.col("z") - F.col("start_us")) / 6e7))).first()
    if bad:
        raise ValueError(f"{bad} of {known} trips with a direction change direction on the way, the longest lasts {longest:.1f} minutes; pass cut_on_direction_change or another identity")
    return trips.join(per.drop("a", "b", "z"), ["vehicle_id", "_s", "start_us"], "left")


def extract_trips(spark: SparkSession, pings: DataFrame | str, terminals: DataFrame | str | None = None, options: Options | None = None, output_path: str | None = None) -> Extract:
    """Trips of raw pings. Empty pings give an empty table of the same columns, and it is written too."""
    o = options or Options()
    cut = cut_trips(spark, pings, terminals, o)
    table = diagnostics(cut.counts, cut.drops, cut.trips)
    out = cut.trips.drop("start_us", "end_us", "_s").orderBy("trip_id")
    write(out, output_path)
    if o.diagnostics_warn:
        warn_of_losses(table)
    return Extract(out, table, cut.projected)


def stop_levels(labels: list[str], terminals: list[str], mapping: dict[str, str] | None) -> dict[str, int]:
    """Direction of each stop label: the place of the terminal that it names or that ``mapping`` gives it."""
    if len(terminals) != 2:
        raise ValueError("stop directions by terminal need exactly two terminals")
    if mapping is None:
        if set(labels) != set(terminals):
            a, b = terminals
            raise ValueError(f"which of {labels} starts at which of {terminals} is not in the data; pass stop_direction_map, e.g. {dict(zip(labels, (a, b)))} or {dict(zip(labels, (b, a)))}")
        mapping = {x: x for x in labels}
    if missing := sorted(set(labels) - set(mapping)):
        raise ValueError(f"stop_direction_map lacks {missing}")
    if unknown := sorted(set(mapping.values()) - set(terminals)):
        raise ValueError(f"stop_direction_map names unknown terminals {unknown}")
    return {x: terminals.index(mapping[x]) + 1 for x in labels}


def extract_trips_and_stop_times(
    spark: SparkSession, pings: DataFrame | str, stops: DataFrame | str, terminals: DataFrame | str | None = None, *,
    stops_buffer_radius: float, stops_extended_buffer_radius: float, stop_direction_map: dict[str, str] | None = None, min_dwell: float = 0.0,
    return_trajectory: bool = False, options: Options | None = None, output_trips_path: str | None = None, output_stops_path: str | None = None,
) -> Extract:
    """Trips and the stops that they visit. Empty pings give empty tables of the same columns, which are not written."""
    o = options or Options()
    for name, v in (("stops_buffer_radius", stops_buffer_radius), ("stops_extended_buffer_radius", stops_extended_buffer_radius)):
        if not math.isfinite(v) or v <= 0:
            raise ValueError(f"{name} must be one positive number")
    if min_dwell < 0:
        raise ValueError("min_dwell must not be negative")
    places = _places(spark, stops, "stop_id")
    if "direction" not in places.columns:
        raise ValueError("stops lack the column direction")
    labels = _distinct(places, "direction")
    cut = cut_trips(spark, pings, terminals, o, labels if o.direction_col else None)
    if cut.mode == "layover":
        places = places.withColumn("direction", F.lit(1)).dropDuplicates(["stop_id", "latitude", "longitude"])
    elif cut.levels is not None:
        places = places.withColumn("direction", level(F.col("direction"), cut.levels))
    else:
        wanted = stop_levels(labels, cut.terminals, stop_direction_map)
        places = places.withColumn("direction", level(F.col("direction"), sorted(wanted, key=wanted.get)) if sorted(wanted.values()) == list(range(1, len(wanted) + 1)) else F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.lit(v))])[F.col("direction")])
    trips = stage(cut.trips, "trips")
    path = stage(trajectory(cut.pings, trips), "trajectory")
    visits = stop_visits(path, places, stops_buffer_radius, stops_extended_buffer_radius, min_dwell, cut.terminals, o.tz or "UTC", o.projected)
    visits = stage(stop_times(visits, trips), "visits")
    table = diagnostics(cut.counts, cut.drops, trips, path, visits)
    trip_table = trips.drop("start_us", "end_us", "_s").orderBy("trip_id")
    stop_table = visits.orderBy("trip_id", "arrival_time", "stop_id", "departure_time", *[c for c in visits.columns if c not in ("trip_id", "arrival_time", "stop_id", "departure_time")])
    if path.limit(1).count():
        write(trip_table, output_trips_path)
        write(stop_table, output_stops_path)
    if o.diagnostics_warn:
        warn_of_losses(table)
    shown = path.drop("_s", "_ord", "t") if return_trajectory else None
    return Extract(trip_table, table, cut.projected, stop_table, shown)
