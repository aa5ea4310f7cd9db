"""The geometry that each trip drove."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, planar_m


def shapes_from_trips(path: DataFrame, prefix: str = "SHP_", projected: bool = False) -> DataFrame:
    """(shape_id, shape_pt_lat, shape_pt_lon, shape_pt_sequence, shape_dist_traveled) of the pings of each trip.

    Sequence from 1, metres driven from 0; pings of no trip take no part; no rows give no shapes.
    """
    w = Window.partitionBy("vehicle_id", "trip_id").orderBy("t", "_ord")
    rows = path.where("trip_id is not null and latitude is not null and longitude is not null")
    metres = (planar_m if projected else haversine_m)(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    rows = rows.withColumn("_m", F.coalesce(metres, F.lit(0.0))).withColumn("shape_pt_sequence", F.row_number().over(w))
    rows = rows.withColumn("shape_dist_traveled", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select(F.concat(F.lit(prefix), F.col("trip_id")).alias("shape_id"), F.col("latitude").alias("shape_pt_lat"), F.col("longitude").alias("shape_pt_lon"), "shape_pt_sequence", "shape_dist_traveled")
