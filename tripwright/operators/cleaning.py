"""Raw pings to clean ones: validated, renamed, deduplicated, with calendar columns; every dropped row counted."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, TimestampType

from .sequence import row_numbers

#: Column names that results add; passthrough columns of these names are left out of trajectories.
RESERVED = ("trip_id", "direction", "bus_stop", "stop_id", "grouped_ends")


@dataclass
class Cleaned:
    """pings with t (micros), date, time_str and _ord (place in the input); one row of what came in and was dropped as
    invalid; projected or not."""

    pings: DataFrame
    inputs: DataFrame
    projected: bool

    @property
    def counts(self) -> DataFrame:
        """One row of counts."""
        return self.counted(self.pings)

    def counted(self, kept: DataFrame) -> DataFrame:
        """One row of counts; ``kept``: the pings, or a table written of them, whose rows are told without cleaning again."""
        held = F.col("pings_in") - F.col("pings_dropped_zero_coord") - F.col("pings_dropped_missing_vehicle")
        one = self.inputs.join(kept.agg(F.count("*").alias("pings_after_cleaning")), how="inner")
        return one.select(*self.inputs.columns, (held - F.col("pings_after_cleaning")).alias("pings_dropped_duplicate"), "pings_after_cleaning")


def id_text(df: DataFrame, name: str) -> Column:
    """An id as text; whole numbers without a point or exponent."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, NumericType):
        whole = c.cast("double") == F.floor(c.cast("double"))
        return F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def blank(c: Column) -> Column:
    """True for null, empty and white-space text."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def local_text(t: Column, tz: str, what: str) -> Column:
    """date, time or hour of micros in ``tz``, whatever the session's zone."""
    shown = F.convert_timezone(F.current_timezone(), F.lit(tz), F.timestamp_micros(t).cast("timestamp_ntz"))
    return F.date_format(shown.cast("timestamp_ntz"), what)


def check_coordinates(df: DataFrame, projected: bool, lat: str = "latitude", lon: str = "longitude", name: str = "pings") -> None:
    """Raise ValueError for missing, non-numeric, null, NaN, infinite or (unless projected) out-of-range coordinates."""
    check_columns(df, lat, lon, name)
    refuse_coordinates(*df.agg(*coordinate_faults(lat, lon)).first(), projected, name)


def check_columns(df: DataFrame, lat: str, lon: str, name: str) -> None:
    for c in (lat, lon):
        if c not in df.columns:
            raise ValueError(f"{name} lacks the column {c}")
        if not isinstance(df.schema[c].dataType, NumericType):
            raise ValueError(f"{name}.{c} is not numeric")


def coordinate_faults(lat: str, lon: str) -> list[Column]:
    """Aggregates: rows whose coordinates are missing or not finite, and rows out of range."""
    x, y = F.col(lat).cast("double"), F.col(lon).cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return [F.count_if(~finite(x) | ~finite(y)).alias("not_finite"), F.count_if((F.abs(x) > 90) | (F.abs(y) > 180)).alias("out_of_range")]


def refuse_coordinates(bad: int, out: int, projected: bool, name: str) -> None:
    if bad:
        raise ValueError(f"{bad} rows of {name} have coordinates that are missing or not finite")
    if out and not projected:
        raise ValueError(f"{out} rows of {name} have coordinates out of range; pass projected=True for metres")


def with_ids(pings: DataFrame) -> DataFrame:
    """``pings`` with a usable ``id``: as they are if all are there and differ, else numbered from 1 in input order.

    pings: best a written table, since it is read to look at the ids.
    """
    if "id" in pings.columns:
        n, there, d = pings.agg(F.count("*"), F.count_if(~blank(F.col("id"))), F.count_distinct("id")).first()
        if n == there == d:
            return pings
    return row_numbers(pings.drop("id"), "id", "_ord", "vehicle_id", "t")


def clean_pings(
    pings: DataFrame, *, vehicle_col: str = "vehicle_id", time_col: str = "timestamp", tz: str | None = None, projected: bool = False,
    dedupe: bool = True, drop_missing_vehicle: bool = True, order_col: str | None = None, default_vehicle: str | None = None, validate: bool = True, ids: bool = True,
) -> Cleaned:
    """Clean pings as all trip operators want them.

    Coordinates must be numbers; a zero latitude or longitude drops the row, so does a blank vehicle (or it raises,
    without drop_missing_vehicle). Times may be timestamps, text in ``tz`` (UTC with a warning if not given) or epoch
    seconds; one that can't be read raises. Of rows with equal vehicle and time the first in input order is kept:
    ``order_col`` gives that order (else id if there is one, else any order). Ids that are missing, blank or repeated are
    numbered anew, all of them (``ids`` False leaves them, for callers that see to it by ``with_ids``). Columns beside
    these pass through. One pass over the data serves all checks and counts; validate=False neither looks nor raises.
    Without any vehicle ``default_vehicle`` is put in. Empty tables stay empty.
    """
    df = pings
    for source, target in ((vehicle_col, "vehicle_id"), (time_col, "timestamp")):
        if source != target:
            if source not in df.columns:
                raise ValueError(f"no column {source}")
            if target in df.columns:
                raise ValueError(f"both {source} and {target} exist")
            df = df.withColumnRenamed(source, target)
    if default_vehicle is not None and "vehicle_id" not in df.columns:
        df = df.withColumn("vehicle_id", F.lit(default_vehicle))
    for c in ("vehicle_id", "timestamp"):
        if c not in df.columns:
            raise ValueError(f"no column {c}")
    check_columns(df, "latitude", "longitude", "pings")
    silent = "speed" not in df.columns
    if silent:
        warnings.warn("no column speed: every speed is null", stacklevel=2)
        df = df.withColumn("speed", F.lit(None).cast("double"))
    kind = df.schema["timestamp"].dataType
    if isinstance(kind, TimestampType):
        t = F.unix_micros("timestamp")
    elif isinstance(kind, NumericType):
        t = (F.col("timestamp").cast("decimal(30,6)") * 1_000_000).cast("bigint")
    else:
        if tz is None and isinstance(kind, StringType):
            warnings.warn("tz not given: text times are read as UTC", stacklevel=2)
        naive = F.col("timestamp").try_cast("timestamp_ntz")
        t = F.unix_micros(F.convert_timezone(F.lit(tz or "UTC"), F.current_timezone(), naive).cast("timestamp"))
    order = F.col(order_col) if order_col else F.col("id") if "id" in df.columns else F.monotonically_increasing_id()
    df = df.withColumns({"t": t, "_ord": order.cast("bigint")})
    zero = (F.col("latitude") == 0) | (F.col("longitude") == 0)
    missing = blank(F.col("vehicle_id"))
    tallies = [F.count("*").alias("pings_in"), F.count_if(zero).alias("pings_dropped_zero_coord"), F.count_if(~zero & missing).alias("pings_dropped_missing_vehicle")]
    inputs = df.agg(*tallies)
    if validate:
        more = [F.count_if(~zero & ~missing & F.col("t").isNull()).alias("no_time"), F.count("speed").alias("speeds"), F.count_if(F.col("vehicle_id").isNotNull()).alias("vehicles"), F.count_if(~zero & F.col("t").isNull()).alias("no_time_at_all")]
        seen = df.agg(*tallies, *coordinate_faults("latitude", "longitude"), *more).first()
        refuse_coordinates(seen.not_finite, seen.out_of_range, projected, "pings")
        placed = default_vehicle is not None and seen.pings_in and not seen.vehicles
        if placed:
            df, missing = df.withColumn("vehicle_id", F.lit(default_vehicle)), F.lit(False)
        no_vehicle = 0 if placed else seen.pings_dropped_missing_vehicle
        if no_vehicle and not drop_missing_vehicle:
            raise ValueError(f"{no_vehicle} pings have no vehicle")
        if no_time := seen.no_time_at_all if placed else seen.no_time:
            raise ValueError(f"{no_time} pings have a time that can't be read")
        if seen.pings_in and not seen.speeds and not silent:
            warnings.warn("every speed is null", stacklevel=2)
        inputs = df.sparkSession.createDataFrame([(seen.pings_in, seen.pings_dropped_zero_coord, no_vehicle)], "pings_in bigint, pings_dropped_zero_coord bigint, pings_dropped_missing_vehicle bigint")
    kept = df.where(~zero & ~missing)
    if dedupe:
        first = Window.partitionBy("vehicle_id", "t").orderBy("_ord")
        kept = kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    kept = kept.withColumns({"date": local_text(F.col("t"), tz or "UTC", "yyyy-MM-dd"), "time_str": local_text(F.col("t"), tz or "UTC", "HH:mm:ss")})
    if ids and (validate or "id" not in kept.columns):
        kept = with_ids(kept)
    return Cleaned(kept, inputs, projected)
