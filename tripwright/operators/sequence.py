"""Order-based column operators: sessions, runs, debouncing, greedy pairing and propagation.

All take pings with vehicle_id and t (micros). ``keyed`` puts each ping into its session by silence, found without
taking a vehicle into one task; every later window is over (vehicle_id, _s), so that a hot vehicle is as many
groups as it has sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..shared import stage
from .sessions import session_of, sessions

KEY = ("vehicle_id", "_s")
SPAN_US = 86_400_000_000


def keyed(pings: DataFrame, gap_us: int) -> DataFrame:
    """``pings`` with _s, the start of the session that each lies in: silences over ``gap_us`` part sessions."""
    span = max(SPAN_US, gap_us)
    rows = pings.withColumn("_span", F.floor(F.col("t") / span))
    found = sessions(rows, "vehicle_id", "t", gap_us, span, distinct=True)
    return session_of(rows, found, "vehicle_id", "t", "_span", span).withColumnRenamed("session_us", "_s").drop("_span")


def session_ids(pings: DataFrame, gap_us: int) -> DataFrame:
    """``pings`` with session_id, numbered from 0 in each vehicle's order of time."""
    rows = keyed(pings, gap_us)
    starts = rows.select(*KEY).distinct()
    numbered = starts.withColumn("session_id", (F.row_number().over(Window.partitionBy("vehicle_id").orderBy("_s")) - 1).cast("bigint"))
    return rows.join(numbered, list(KEY)).drop("_s")


def in_order(*extra: str) -> WindowSpec:
    """Rows of a session (and ``extra`` keys) by time and input order."""
    return Window.partitionBy(*KEY, *extra).orderBy("t", "_ord")


def up_to(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def run_id(value: Column, w: WindowSpec) -> Column:
    """Number of the run of equal values (null equals null) that a row lies in, from 0; needs nesting by the caller:
    returns the change flag, to be summed."""
    return F.when(F.row_number().over(w) == 1, 0).when(value.eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)


def with_runs(df: DataFrame, name: str, value: Column, w: WindowSpec) -> DataFrame:
    """``df`` with run number ``name`` (from 0) of ``value`` in window order."""
    return df.withColumn("_c", run_id(value, w)).withColumn(name, F.sum("_c").over(up_to(w))).drop("_c")


def debounced(df: DataFrame, name: str, value: str, min_pings: int = 2, min_seconds: float = 600) -> DataFrame:
    """``df`` with ``name``: ``value`` without short flips, per vehicle.

    A run qualifies with at least min_pings rows and min_seconds from its first to its last; others take the
    qualifying value before them, rows before the first qualifying run take that one's. A vehicle without a qualifying
    run takes its commonest value (of equals the first in alphabet); with one run only it is left as it is. Each
    null is a run of its own. The series of a vehicle spans sessions, so the run table, not the rows, is
    ordered per vehicle.
    """
    if min_pings <= 1 and min_seconds <= 0:
        return df.withColumn(name, F.col(value).cast("string"))
    v = F.col(value).cast("string")
    order = in_order()
    same = v.isNotNull() & (v == F.lag(v).over(order))
    rows = df.withColumn("_c", F.when(same, 0).otherwise(1)).withColumn("_r", F.sum("_c").over(up_to(order)))
    parts = rows.groupBy(*KEY, "_r").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"), F.first(v).alias("value"))
    by_vehicle = Window.partitionBy("vehicle_id").orderBy("a")
    # runs that sessions cut in two are one run
    joins = F.col("value").isNotNull() & (F.col("value") == F.lag("value").over(by_vehicle))
    parts = parts.withColumn("_j", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("_j").over(up_to(by_vehicle)))
    in_run = Window.partitionBy("vehicle_id", "run")
    counts, spans = F.sum("n").over(in_run), F.max("b").over(in_run) - F.min("a").over(in_run)
    parts = parts.withColumn("ok", (counts >= min_pings) & (spans >= int(min_seconds * 1_000_000)))
    whole = Window.partitionBy("vehicle_id")
    votes = parts.where("value is not null").groupBy("vehicle_id", "value").agg(F.sum("n").alias("n"))
    modal = votes.groupBy("vehicle_id").agg(F.min(F.struct(-F.col("n"), F.col("value").alias("value"))).alias("m")).select("vehicle_id", F.col("m.value").alias("modal"))
    good = F.when(F.col("ok"), F.col("value"))
    before = F.last(good, ignorenulls=True).over(up_to(by_vehicle))
    first = F.min(F.when(F.col("ok"), F.struct("a", "value"))).over(whole)["value"]
    any_ok, runs_of = F.max(F.col("ok").cast("int")).over(whole), F.max("run").over(whole)
    parts = parts.withColumns({"_before": before, "_first": first, "_any": any_ok, "_runs": runs_of}).join(modal, "vehicle_id", "left")
    new = F.when(F.col("_runs") <= 1, F.col("value")).when(F.col("_any") == 0, F.col("modal")).otherwise(F.coalesce("_before", "_first"))
    return rows.join(parts.select(*KEY, "_r", new.alias(name)), [*KEY, "_r"]).drop("_c", "_r")


def paired(df: DataFrame, eligible: Column, w: WindowSpec) -> DataFrame:
    """``df`` with _start: the row begins a pair with the next one, pairs taken greedily from the left.

    ``eligible`` tells whether a row may pair with the next. In a maximal run of eligible rows the greedy
    choice is every other one, from the first.
    """
    e = F.coalesce(eligible, F.lit(False))
    rows = df.withColumn("_e", e)
    rows = rows.withColumn("_b", F.sum(F.when(F.col("_e"), 0).otherwise(1)).over(up_to(w)))
    place = F.sum(F.col("_e").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_p", place)
    base = F.min("_p").over(Window.partitionBy(*KEY, "_b"))
    first = F.when(F.col("_b") == 0, F.lit(0)).otherwise(base)
    return rows.withColumn("_start", F.col("_e") & ((F.col("_p") - first) % 2 == 1)).drop("_e", "_b", "_p")


def numbered(trips: DataFrame, name: str = "trip_id") -> DataFrame:
    """``trips`` with ``name``: 1..T by vehicle and start.

    Vehicles get the number of trips before them, from a table of one row a vehicle; trips count on from there.
    """
    per = trips.groupBy("vehicle_id").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("vehicle_id").rowsBetween(Window.unboundedPreceding, -1))
    base = per.select("vehicle_id", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("vehicle_id").orderBy("start_us"))
    return trips.join(base, "vehicle_id").withColumn(name, (F.col("_base") + own).cast("int")).drop("_base")


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df``, written once, with _part: rows of a lower part come before those of a higher one in ``order``.

    With an order that tells rows apart no value, however frequent, makes one part large.
    """
    return stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def part_sums(parts: DataFrame, **sums: Column) -> DataFrame:
    """(_part, *sums): totals over the parts before each; a row a part, as many as a shuffle has partitions."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(*[v.alias(k) for k, v in sums.items()])
    return totals.select("_part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums])


def row_numbers(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with ``name``: 1..N over the whole table in ``order``, numbered within parts behind the rows of the parts before."""
    parts = ranged(df, *order)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    base = part_sums(parts, _base=F.count("*"))
    return parts.join(F.broadcast(base), "_part").withColumn(name, (F.col("_base") + own).cast("bigint")).drop("_part", "_base")
