"""Vehicle, instant and kept row: what the queries over pings share."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.timestamps import trimmed
from ..shared import new_path
from .timestamps import normalise, settled

#: Rows of a vehicle are spread over tasks by spans of a day; all gaps looked for are shorter.
SPAN_US = 86_400_000_000


def _written(pings: DataFrame, feeds: DataFrame, columns: tuple[str, ...], name: str, last: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``last`` of the rows with vehicle and readable timestamp, written once.

    The instants are those of ``normalise``: while the rows are written it is counted for how many the cheapest reading isn't
    proven to be Viterbi's; if there are any, they are written again by way of the full path search.
    """
    spark = pings.sparkSession
    rows = pings.withColumn("vehicle_id", trimmed(F.col("vehicle_id")))
    rows = rows.where(F.col("vehicle_id") != "")
    seen = Observation()
    out = settled(rows, feeds, "id", "vehicle_id", *columns).observe(seen, F.count_if(~F.col("settled")).alias("open"))
    shape = ["id", "vehicle_id", F.col("instant_us").alias("t"), F.floor(F.col("instant_us") / SPAN_US).alias("span"), *columns]
    out = last(out.where("instant_us is not null").select(*shape))
    path = new_path(spark, name)
    out.write.parquet(path)
    try:
        unproven = seen.get["open"] > 0
    except Py4JJavaError:  # nothing was observed, so nothing is proven
        unproven = True
    if unproven:
        path = new_path(spark, name)
        last(normalise(rows, feeds, "vehicle_id", *columns).where("instant_us is not null").select(*shape)).write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def arrivals(pings: DataFrame, feeds: DataFrame, *columns: str) -> DataFrame:
    """Rows with vehicle and readable timestamp: (id, vehicle_id trimmed, t, span, *columns), staged; t in micros, span its day."""
    return _written(pings, feeds, columns, "arrivals", lambda rows: rows)


def kept(arrived: DataFrame) -> DataFrame:
    """Of all rows with the same vehicle and instant the one with the smallest id.

    The rank is cut to one before the exchange too, so a group of copies of any size shrinks where it lies.
    """
    w = Window.partitionBy("vehicle_id", "span", "t").orderBy("id")
    return arrived.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def kept_rows(pings: DataFrame, feeds: DataFrame, *columns: str) -> DataFrame:
    """The kept rows of ``pings``, staged; nothing is written on the way."""
    return _written(pings, feeds, columns, "kept", kept)
