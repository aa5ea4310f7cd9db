"""Queries of the general data operators over the pings, stops and terminals of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pings as P
from ..operators.proximity import inside, near
from ..operators.seen import SeenStore
from ..operators.sessions import sessions
from ..operators.timestamps import normalise
from ..operators.tracks import GAP_US, implausible_readings, stops_and_trips
from ..shared import new_path
from ..sources.tables import table
from . import data_sql


def _arrivals(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return P.arrivals(table(spark, d, "gps_data"), table(spark, d, "feeds"), *columns)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every session of a vehicle, parted by more than four hours of silence."""
    return p1_sessions(spark, d).select("vehicle_id", "start_us", "end_us")


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with duration and number of pings."""
    return sessions(_arrivals(spark, d), "vehicle_id", "t", GAP_US)


def _track_rows(spark: SparkSession, d: str) -> DataFrame:
    return P.kept_rows(table(spark, d, "gps_data"), table(spark, d, "feeds"), "latitude", "longitude", "speed")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every stop and trip of a vehicle."""
    return p2_moves(spark, d).select("kind", "vehicle_id", "start_us", "end_us")


def p2_moves(spark: SparkSession, d: str) -> DataFrame:
    """Stops and trips with duration, distance and number of pings."""
    return stops_and_trips(_track_rows(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Terminals within 250 m of a stop."""
    return p3_near(spark, d).select("stop_id", "terminal_id")


def p3_near(spark: SparkSession, d: str) -> DataFrame:
    """The same with the least distance of each pair."""
    pairs = near(table(spark, d, "stops_data"), table(spark, d, "terminals_data"), 250.0, "stop_id", "terminal_id")
    return pairs.withColumn("metres", F.round("metres", 6))


def p3_regions(spark: SparkSession, d: str) -> DataFrame:
    """Stops within the regions that the lines of routes enclose."""
    rings = table(spark, d, "route_lines").withColumn("region", F.concat("route_id", F.lit("/"), "direction"))
    return inside(table(spark, d, "stops_data"), rings, "stop_id", "region")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Positions and speeds that can't be true."""
    return implausible_readings(_track_rows(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Instants of all readable timestamps that aren't written canonically."""
    out = normalise(table(spark, d, "gps_data"), table(spark, d, "feeds"))
    return out.where(F.col("instant_us").isNotNull() & ~F.col("canonical")).select("id", "instant_us")


#: Runs of delivery batches that p7_found absorbs one after another.
WAVES = 4


def waves(arrived: DataFrame, n: int = WAVES) -> list[DataFrame]:
    """``arrived`` (id, batch_id, ...) in ``n`` runs of whole delivery batches, cut at the first id of a batch.

    Ids number the arrivals, so an earlier run holds smaller ids only, also if some rows name no batch or a wrong one.
    """
    cuts = arrived.agg(F.percentile_approx("batch_id", [i / n for i in range(1, n)], 1000).alias("b")).first().b or []
    firsts = arrived.agg(*[F.min(F.when(F.col("batch_id") > c, F.col("id"))).alias(f"c{i}") for i, c in enumerate(cuts)]).first() if cuts else []
    edges = sorted({x for x in firsts if x is not None})
    bounds = [None, *edges, None]
    part = lambda lo, hi: (F.lit(True) if lo is None else F.col("id") >= lo) & (F.lit(True) if hi is None else F.col("id") < hi)
    return [arrived.where(part(lo, hi)) for lo, hi in zip(bounds, bounds[1:])]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals that repeat an identifier seen before, in their own batch or in one absorbed earlier."""
    arrived = _arrivals(spark, d, "batch_id")
    store = SeenStore(spark, new_path(spark, "seen"))
    kept = [store.absorb(w.select("id", F.col("vehicle_id").alias("k"), F.col("t").alias("at")), i) for i, w in enumerate(waves(arrived))]
    first = kept[0]
    for more in kept[1:]:
        first = first.unionByName(more)
    return arrived.select("id").join(first, "id", "left_anti")


QUERIES = {f.__name__: f for f in (p1_found, p1_sessions, p2_found, p2_moves, p3_found, p3_near, p3_regions, p5_found, p6_found, p7_found)}

_VALID = "latitude <> 0 AND longitude <> 0 AND abs(latitude) <= 90 AND abs(longitude) <= 180"
_NEAR = f"""
WITH s AS (SELECT DISTINCT stop_id, latitude, longitude FROM stops_data WHERE {_VALID}),
t AS (SELECT DISTINCT terminal_id, latitude, longitude FROM terminals_data WHERE {_VALID}),
m AS (
  SELECT stop_id, terminal_id, 2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(t.latitude - s.latitude) / 2), 2)
    + cos(radians(s.latitude)) * cos(radians(t.latitude)) * pow(sin(radians(t.longitude - s.longitude) / 2), 2)))) AS metres
  FROM s JOIN t ON abs(s.latitude - t.latitude) < 0.003)
SELECT stop_id, terminal_id, round(min(metres), 6) AS metres FROM m WHERE metres <= 250 GROUP BY ALL"""

_REGIONS = """
WITH v AS (SELECT DISTINCT route_id || '/' || direction AS region, vertex_seq, latitude, longitude FROM route_lines
  WHERE route_id IS NOT NULL AND direction IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND vertex_seq IS NOT NULL),
e AS (SELECT region, latitude AS y1, longitude AS x1, coalesce(lead(latitude) OVER w, first_value(latitude) OVER w) AS y2, coalesce(lead(longitude) OVER w, first_value(longitude) OVER w) AS x2,
  count(*) OVER (PARTITION BY region) AS n FROM v WINDOW w AS (PARTITION BY region ORDER BY vertex_seq, latitude, longitude)),
p AS (SELECT DISTINCT stop_id, latitude AS y, longitude AS x FROM stops_data WHERE stop_id IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL),
c AS (SELECT stop_id, y, x, region, count(*) AS k FROM p JOIN e ON n >= 3 AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL)
SELECT DISTINCT stop_id, region FROM c WHERE k % 2 = 1"""

ORACLE = data_sql.ORACLE | {"p3_found": f"SELECT stop_id, terminal_id FROM ({_NEAR})", "p3_near": _NEAR, "p3_regions": _REGIONS}
