"""What survived each stage of an extraction, as a table of thirteen metrics."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stage and metric, in order of display.
METRICS = [
    ("input", "pings_in"),
    ("cleaning", "pings_dropped_zero_coord"),
    ("cleaning", "pings_dropped_missing_vehicle"),
    ("cleaning", "pings_dropped_duplicate"),
    ("cleaning", "pings_after_cleaning"),
    ("segmentation", "rows_dropped_no_trip_identity"),
    ("segmentation", "segments_dropped_single_ping"),
    ("segmentation", "segments_dropped_stationary"),
    ("trips", "pings_assigned_to_trips"),
    ("trips", "pings_dropped_not_in_trip"),
    ("trips", "trips_kept"),
    ("trips", "max_trip_duration_mins"),
    ("stops", "stop_times_kept"),
]


def diagnostics(counts: DataFrame, drops: dict[str, DataFrame], trips: DataFrame, path: DataFrame | None = None, visits: DataFrame | None = None) -> DataFrame:
    """(stage, metric, n): one row a metric; what this run can't measure is null, not zero."""
    one = counts.select(*[F.col(m).alias(m) for _, m in METRICS if m in counts.columns])
    for name, df in drops.items():
        one = one.join(df.select(F.col("n").alias(name)), how="inner")  # one row each
    longest = F.when(F.count("*") > 0, F.bround(F.max("duration_in_mins")))
    one = one.join(trips.agg(F.count("*").alias("trips_kept"), longest.cast("bigint").alias("max_trip_duration_mins")), how="inner")
    if path is not None:
        one = one.join(path.agg(F.count("trip_id").alias("pings_assigned_to_trips"), F.count_if(F.col("trip_id").isNull()).alias("pings_dropped_not_in_trip")), how="inner")
    if visits is not None:
        one = one.join(visits.agg(F.count("*").alias("stop_times_kept")), how="inner")

    def value(m: str) -> Column:
        return F.col(m).cast("bigint") if m in one.columns else F.lit(None).cast("bigint")

    entries = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(m).alias("metric"), value(m).alias("n")) for s, m in METRICS])
    return one.select(F.inline(entries))


def summary(table: DataFrame) -> str:
    """The table in words: what came in, what came out, what was dropped, most first."""
    n = {r.metric: r.n for r in table.collect()}
    show = lambda x: "NA" if x is None else f"{x:,}"
    out = f"{show(n['pings_in'])} pings in -> {show(n['trips_kept'])} trips"
    if n["stop_times_kept"] is not None:
        out += f", {show(n['stop_times_kept'])} stop_times"
    dropped = sorted(((m, x) for m, x in n.items() if "dropped" in m and x), key=lambda p: -p[1])
    if not dropped:
        return out + "\n  nothing dropped"
    return out + "".join(["\n  dropped:", *[f"\n    {m}: {show(x)}" for m, x in dropped]])


def warn_of_losses(table: DataFrame) -> None:
    """Warn of what was dropped, each reason in its own unit; repeated pings are routine and never warned of."""
    n = {r.metric: r.n for r in table.collect()}
    lost = sorted(((m, x) for m, x in n.items() if "dropped" in m and m != "pings_dropped_duplicate" and x), key=lambda p: -p[1])
    if lost:
        reasons = ", ".join(f"{m} ({x:,})" for m, x in lost)
        warnings.warn(f"kept {n['trips_kept']:,} trips of {n['pings_in']:,} pings; dropped {reasons}", stacklevel=2)
