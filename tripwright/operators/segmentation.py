"""Trips cut from keyed pings: by supplied identities, between terminals, or at layovers.

Each returns one row a trip: vehicle_id, _s, start_us, end_us, the positions of both ends, and what the cut
knows (start_terminal, end_terminal, provided_trip_id). Trips of a vehicle never overlap.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import blank
from .dwell import dwell_runs
from .matching import nearest, radius_match
from .sequence import KEY, in_order, paired, up_to, with_runs


@dataclass
class Trips:
    """trips, and one-row counts of what the cut dropped: name of the diagnostic to a DataFrame with column n."""

    trips: DataFrame
    drops: dict[str, DataFrame] = field(default_factory=dict)


def identity(columns: list[str]) -> Column:
    """One column as text; several joined by '_', with null as empty, and null if all are empty."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    joined = F.concat_ws("_", *parts)
    none = F.lit(True)
    for p in parts:
        none = none & (p == "")
    return F.when(~none, joined)


def _ends(g: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds of groups of pings."""
    first, last = F.min_by(F.struct("latitude", "longitude"), "t"), F.max_by(F.struct("latitude", "longitude"), "t")
    return g.groupBy(*keys).agg(F.min("t").alias("start_us"), F.max("t").alias("end_us"), first.alias("_f"), last.alias("_l"), F.count("*").alias("n_pings"))


def by_identity(pings: DataFrame, columns: list[str], gap_us: int) -> Trips:
    """Maximal series of one identity within a session of identified pings, of two pings or more.

    Pings without identity don't break a series. A series of one ping is dropped after the cut, so
    it still parts its neighbours.
    """
    rows = pings.withColumn("_i", identity(columns))
    has = rows.where(~blank(F.col("_i")))
    w = in_order()
    cut = F.lag("t").over(w).isNull() | (F.col("t") - F.lag("t").over(w) > gap_us) | (F.lag("_i").over(w) != F.col("_i"))
    has = has.withColumn("_c", F.when(cut, 1).otherwise(0)).withColumn("_g", F.sum("_c").over(up_to(w)))
    all_ = _ends(has, [*KEY, "_g", "_i"])
    drops = {
        "rows_dropped_no_trip_identity": rows.agg(F.count_if(blank(F.col("_i"))).alias("n")),
        "segments_dropped_single_ping": all_.agg(F.count_if(F.col("n_pings") < 2).alias("n")),
    }
    trips = all_.where("n_pings >= 2").withColumn("provided_trip_id", F.col("_i")).drop("_g", "_i")
    return Trips(trips, drops)


def terminal_visits(pings: DataFrame, terminals: DataFrame, radius: float, projected: bool = False) -> DataFrame:
    """(vehicle_id, _s, t, bus_stop, _ord): first and last ping of each stay at a terminal on one date.

    A stay is a series of matched pings at one terminal: pings matched to none vanish first, so leaving and coming back
    is one stay. A stay of one ping is one row.
    """
    at = radius_match(pings, terminals, "terminal_id", radius, name="bus_stop", projected=projected).where("bus_stop is not null")
    runs = with_runs(at, "_g", F.struct("bus_stop", "date"), in_order())
    stays = runs.groupBy(*KEY, "_g", "bus_stop").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return stays.select(*KEY, F.explode(F.array_distinct(F.array("a", "b"))).alias("t"), "bus_stop").withColumn("_ord", F.lit(0))


def by_terminals(pings: DataFrame, terminals: DataFrame, radius: float, gap_us: int, projected: bool = False) -> Trips:
    """From the last ping at one terminal to the first at another, at most ``gap_us`` later."""
    rows = terminal_visits(pings, terminals, radius, projected)
    w = in_order()
    rows = rows.withColumns({"_t": F.lead("t").over(w), "_to": F.lead("bus_stop").over(w)})
    rows = paired(rows, (F.col("_to") != F.col("bus_stop")) & (F.col("_t") - F.col("t") <= gap_us), w)
    trips = rows.where("_start").select(*KEY, F.col("t").alias("start_us"), F.col("_t").alias("end_us"), F.col("bus_stop").alias("start_terminal"), F.col("_to").alias("end_terminal"))
    return Trips(trips)


def layover_segments(pings: DataFrame, layover_gap_us: int, radius: float, projected: bool = False) -> DataFrame:
    """Pings with their dwell run, whether it is a layover, place in it and segment; interior layover pings too."""
    rows = dwell_runs(pings, radius, projected)
    run = Window.partitionBy(*KEY, "run")
    w = in_order()
    rows = rows.withColumns({
        "run_n": F.count("*").over(run), "run_span": F.max("t").over(run) - F.min("t").over(run),
        "run_pos": F.row_number().over(run.orderBy("t", "_ord")), "gap_prev": F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0)),
    })
    rows = rows.withColumn("layover", (F.col("run_n") >= 2) & (F.col("run_span") > layover_gap_us))
    new = (F.col("gap_prev") > layover_gap_us) | (F.col("layover") & (F.col("run_pos") == F.col("run_n")))
    return rows.withColumn("_c", F.when(new, 1).otherwise(0)).withColumn("seg", F.sum("_c").over(up_to(w))).drop("_c")


def by_layover(pings: DataFrame, layover_gap_us: int, radius: float, terminals: DataFrame | None = None, projected: bool = False) -> Trips:
    """Between layovers: a silence over the gap, or a stay within ``radius`` for longer than it.

    The arrival ping of a stay ends the old trip, its departure ping begins the new one, those between belong to none.
    Segments of one ping, or that never left one dwell run, are no trips. Ends are named by the nearest terminal.
    """
    rows = layover_segments(pings, layover_gap_us, radius, projected)
    rows = rows.where(~(F.col("layover") & (F.col("run_pos") > 1) & (F.col("run_pos") < F.col("run_n"))))
    per = rows.groupBy(*KEY, "seg").agg(
        F.min("t").alias("start_us"), F.max("t").alias("end_us"), F.min_by(F.struct("latitude", "longitude"), "t").alias("_f"),
        F.max_by(F.struct("latitude", "longitude"), "t").alias("_l"), F.count("*").alias("n_pings"), (F.max("run") - F.min("run") + 1).alias("_runs"),
    )
    drops = {
        "segments_dropped_single_ping": per.agg(F.count_if(F.col("n_pings") < 2).alias("n")),
        "segments_dropped_stationary": per.agg(F.count_if((F.col("n_pings") >= 2) & (F.col("_runs") < 2)).alias("n")),
    }
    trips = per.where("n_pings >= 2 and _runs >= 2").drop("seg", "_runs")
    return Trips(named_ends(trips, terminals, projected), drops)


def named_ends(trips: DataFrame, terminals: DataFrame | None, projected: bool = False) -> DataFrame:
    """``trips`` with start_terminal and end_terminal, the nearest to either end; null without terminals."""
    if terminals is None:
        return trips.withColumns({"start_terminal": F.lit(None).cast("string"), "end_terminal": F.lit(None).cast("string")})
    rows = trips.withColumns({"_a": F.col("_f.latitude"), "_b": F.col("_f.longitude"), "_c": F.col("_l.latitude"), "_d": F.col("_l.longitude")})
    rows = nearest(rows, terminals, "terminal_id", "_a", "_b", "start_terminal", projected)
    rows = nearest(rows, terminals, "terminal_id", "_c", "_d", "end_terminal", projected)
    return rows.drop("_a", "_b", "_c", "_d", "start_terminal_m", "end_terminal_m")
