"""Pings, terminals, stops and a feed derived from the table of events, in Spark and in SQL alike.

Each user is a vehicle that goes to and fro between two terminals past five stops; each event is five pings. The
layover variant waits at both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

A_LAT, STEP_M, DEGREE_M, LON = 52.0, 1000, 111195.0, 9.0
B_LAT = A_LAT + 6 * STEP_M / DEGREE_M


def _pos(seq: Column, layover: bool) -> Column:
    if layover:
        k = seq % 18
        return F.when(k <= 3, 0).when(k <= 8, k - 3).when(k <= 12, 6).otherwise(18 - k)
    m = seq % 12
    return F.when(m <= 6, m).otherwise(12 - m)


def pings(spark: SparkSession, d: str, layover: bool = False) -> DataFrame:
    """id, vehicle_id, timestamp, latitude, longitude, speed, trip_key (null on some), dir_flag, dir_noisy, route_id, pos, seq, event_id."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.repartition(spark.sparkContext.defaultParallelism, "user_id")  # each event becomes five pings: keep all tasks
    e = e.select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("tt"), (F.row_number().over(w) - 1).alias("seq"))
    e = e.withColumn("pos", _pos(F.col("seq"), layover)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
    still = (F.col("j") == 2) | ((F.col("j") == 3) & F.col("event_type").isin("view", "click"))
    flag = F.floor(F.col("seq") / 6) % 2
    return e.select(
        (F.col("event_id") * 5 + F.col("j")).alias("id"), F.col("user_id").alias("vehicle_id"), F.timestamp_micros(F.col("tt") + F.col("j") * 10_000_000).alias("timestamp"),
        (F.lit(A_LAT) + (STEP_M * F.col("pos") + 70 * (F.col("j") - 2)) / F.lit(DEGREE_M)).alias("latitude"), F.lit(LON).alias("longitude"),
        F.when(still, 0.0).otherwise(7.0).alias("speed"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("T"), F.floor(F.col("seq") / 12))).alias("trip_key"),
        flag.cast("string").alias("dir_flag"), F.when(F.col("event_id") % 11 == 0, 1 - flag).otherwise(flag).cast("string").alias("dir_noisy"),
        F.concat(F.lit("r"), F.col("user_id") % 10).alias("route_id"), "pos", "seq", "event_id",
    )


def dirty_pings(spark: SparkSession, d: str) -> DataFrame:
    """The pings with zero coordinates, blank vehicles and repeated rows among them; vehicle_id is text."""
    p = pings(spark, d).withColumn("vehicle_id", F.when(F.col("event_id") % 89 == 0, F.lit(" ")).otherwise(F.col("vehicle_id").cast("string")))
    p = p.withColumn("latitude", F.when(F.col("event_id") % 97 == 0, 0.0).otherwise(F.col("latitude")))
    return p.unionByName(p.where("event_id % 83 = 0").withColumn("id", F.col("id") + 10_000_000_000))


def terminals(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES ('A', {A_LAT}D, {LON}D, 1), ('B', {B_LAT!r}D, {LON}D, 2) AS t(terminal_id, latitude, longitude, ord)")


def stops(spark: SparkSession) -> DataFrame:
    """Five stops for each direction, labelled by the terminal it starts from; the terminals among them."""
    rows = [(f"S{k}{t}", t, A_LAT + STEP_M * k / DEGREE_M, LON, 10 * i + k) for i, t in enumerate("AB") for k in range(1, 6)]
    rows += [("A", "A", A_LAT, LON, 100), ("B", "B", B_LAT, LON, 101)]
    values = ", ".join(f"('{i}', '{t}', {a!r}D, {b!r}D, {o})" for i, t, a, b, o in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(stop_id, direction, latitude, longitude, ord)")


def feed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A planned feed of one route: each vehicle's cycle is a trip, its stops the places passed."""
    p = pings(spark, d).where("id % 5 = 0").withColumn("trip_id", F.concat_ws("_", F.col("vehicle_id").cast("string"), F.floor(F.col("seq") / 6).cast("string")))
    places = spark.range(7).select(F.concat(F.lit("S"), "id").alias("stop_id"), F.concat(F.lit("Place "), "id").alias("stop_name"), (F.lit(A_LAT) + STEP_M * F.col("id") / F.lit(DEGREE_M)).alias("stop_lat"), F.lit(LON).alias("stop_lon"))
    return {
        "trips": p.select("trip_id", F.lit("r1").alias("route_id")).distinct(),
        "stop_times": p.select("trip_id", F.concat(F.lit("S"), F.col("pos")).alias("stop_id"), F.col("seq").cast("double").alias("stop_sequence")),
        "stops": places,
    }


def _sql(layover: bool) -> str:
    pos = "CASE WHEN seq % 18 <= 3 THEN 0 WHEN seq % 18 <= 8 THEN seq % 18 - 3 WHEN seq % 18 <= 12 THEN 6 ELSE 18 - seq % 18 END" if layover else "CASE WHEN seq % 12 <= 6 THEN seq % 12 ELSE 12 - seq % 12 END"
    return f"""ev AS (SELECT event_id, epoch_us(ts) AS tt, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
ep AS (SELECT *, {pos} AS pos FROM ev),
pings AS (SELECT event_id * 5 + j AS id, user_id AS vehicle_id, tt + j * 10000000 AS t, {A_LAT} + ({STEP_M} * pos + 70 * (j - 2)) / {DEGREE_M} AS latitude,
  CAST({LON} AS DOUBLE) AS longitude, CASE WHEN j = 2 OR (j = 3 AND event_type IN ('view', 'click')) THEN 0.0 ELSE 7.0 END AS speed,
  CASE WHEN event_id % 7 <> 0 THEN 'T' || (seq // 12) END AS trip_key, CAST((seq // 6) % 2 AS VARCHAR) AS dir_flag,
  CAST(CASE WHEN event_id % 11 = 0 THEN 1 - (seq // 6) % 2 ELSE (seq // 6) % 2 END AS VARCHAR) AS dir_noisy,
  'r' || (user_id % 10) AS route_id, pos, seq, event_id FROM ep, (SELECT unnest(range(5)) AS j) jj)"""


PINGS_SQL, LAYOVER_SQL = _sql(False), _sql(True)
