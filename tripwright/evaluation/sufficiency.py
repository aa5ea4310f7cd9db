"""Whether observations suffice to judge anything; and the splits of data for evaluation."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m


def _steps(pings: DataFrame) -> DataFrame:
    w = Window.partitionBy("vehicle_id", "service_day").orderBy("t", "id")
    rows = pings.withColumn("service_day", F.floor(F.col("t") / 86_400_000_000))
    return rows.withColumn("step", haversine_m(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude")))


def moving_segments(pings: DataFrame, threshold_m: float = 25.0) -> DataFrame:
    """(route_id, moving_segments): runs of steps over ``threshold_m`` within a vehicle's day; routes without any have 0."""
    w = Window.partitionBy("vehicle_id", "service_day").orderBy("t", "id")
    rows = _steps(pings).withColumn("moving", F.coalesce(F.col("step") > threshold_m, F.lit(False)))
    begins = F.col("moving") & ~F.coalesce(F.lag("moving").over(w), F.lit(False))
    rows = rows.withColumn("_b", begins.cast("int")).withColumn("run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where("moving").select("route_id", "vehicle_id", "service_day", "run").distinct()
    some = runs.groupBy("route_id").agg(F.count("*").alias("n"))
    every = pings.select("route_id").distinct()
    joined = every.alias("e").join(some.alias("s"), F.col("e.route_id").eqNullSafe(F.col("s.route_id")), "left")
    return joined.select(F.col("e.route_id").alias("route_id"), F.coalesce("n", F.lit(0)).alias("moving_segments"))


def data_sufficiency(
    pings: DataFrame, min_span_hours: float = 12, min_vehicle_days: int = 20, min_pings: int = 30, min_day_hours: float = 4, min_move_m: float = 1000, min_segments: int = 30, move_m: float = 25.0
) -> DataFrame:
    """One row of what the pings (id, vehicle_id, route_id, t, latitude, longitude) amount to.

    A vehicle's day is complete with enough pings, span and movement; only the span of all and the number of
    complete days decide ``sufficient``, the rest is advice.
    """
    day = _steps(pings).groupBy("vehicle_id", "service_day").agg(F.count("*").alias("n"), ((F.max("t") - F.min("t")) / 3.6e9).alias("hours"), F.sum("step").alias("moved"))
    day = day.withColumn("complete", (F.col("n") >= min_pings) & (F.col("hours") >= min_day_hours) & (F.col("moved").isNull() | (F.col("moved") >= min_move_m)))
    a = day.agg(F.count_if("complete").alias("complete_vehicle_days"), F.count("*").alias("total_vehicle_days"), F.median("moved").alias("median_vehicle_day_move_m"), F.median("n").alias("median_pings_per_vehicle_day"))
    b = moving_segments(pings, move_m).agg(F.count("*").alias("n_routes"), F.count_if(F.col("moving_segments") >= min_segments).alias("routes_meeting_min_segments"), F.median("moving_segments").alias("median_moving_segments_per_route"))
    c = pings.agg(((F.max("t") - F.min("t")) / 3.6e9).alias("observation_span_hours"), F.count("*").alias("n_pings"))
    t = c.join(a, how="inner").join(b, how="inner")
    return t.withColumn("sufficient", F.coalesce((F.col("observation_span_hours") >= min_span_hours) & (F.col("complete_vehicle_days") >= min_vehicle_days), F.lit(False)))


@dataclass
class Splits:
    calibration: DataFrame
    heldout: DataFrame
    transfer: DataFrame | None
    transfer_claim_supported: bool


def make_splits(data: DataFrame, agency_a: str, agency_b: str | None = None, period_col: str | None = None, calibration_periods: list | None = None) -> Splits:
    """Calibration and held-out data of one agency, and data of another to transfer to.

    By ``period_col`` and the periods of calibration, or by a column split ('calibration', 'heldout'). The other agency
    must be another. An empty part is warned of.
    """
    if "agency" not in data.columns:
        raise ValueError("data lack the column agency")
    if agency_b is not None and agency_b == agency_a:
        raise ValueError("agency_b must differ from agency_a")
    a = data.where(F.col("agency") == agency_a)
    if period_col is not None:
        if calibration_periods is None:
            raise ValueError("period_col needs calibration_periods")
        inside = F.coalesce(F.col(period_col).isin(calibration_periods), F.lit(False))
        calibration, heldout = a.where(inside), a.where(~inside)
    elif "split" in data.columns:
        calibration, heldout = a.where("split = 'calibration'"), a.where("split = 'heldout'")
    else:
        raise ValueError("pass period_col with calibration_periods, or a column split")
    if calibration.isEmpty() or heldout.isEmpty():
        warnings.warn("the calibration or held-out part is empty", stacklevel=2)
    transfer = data.where(F.col("agency") == agency_b) if agency_b is not None else None
    return Splits(calibration, heldout, transfer, transfer is not None and not transfer.isEmpty())
