"""Sessions parted by silence, as a sweep over the line of time.

Every activity adds one where it begins and takes one away a gap after it ends; where the running sum falls to
zero a session closes. The sweep runs twice: over the rows of a key's span of time (a day, so that a hot key
is many tasks), which leaves a few fragments each, then over the fragments of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sweep(activity: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Unions of activities (keys, s, e, n) whose neighbours are at most ``gap_us`` apart: (keys, start_us, end_us, n_events)."""
    own = [F.col(k) for k in keys]
    opens = F.struct(F.col("s").alias("at"), F.lit(1).alias("delta"), F.col("n").alias("n"))
    closes = F.struct((F.col("e") + F.lit(gap_us)).alias("at"), F.lit(-1).alias("delta"), F.lit(0).cast("bigint").alias("n"))
    deltas = activity.select(*own, F.inline(F.array(opens, closes)))
    # at one point openings come first, so a silence of exactly the gap doesn't close
    w = Window.partitionBy(*own).orderBy("at", F.desc("delta")).rowsBetween(Window.unboundedPreceding, 0)
    running = deltas.withColumn("level", F.sum("delta").over(w))
    begins = (F.col("level") == 1) & (F.col("delta") == 1)
    numbered = running.withColumn("_no", F.sum(F.when(begins, 1).otherwise(0)).over(w))
    out = numbered.groupBy(*own, "_no").agg(
        F.min("at").alias("start_us"), (F.max("at") - F.lit(gap_us)).alias("end_us"), F.sum("n").alias("n_events")
    )
    return out.drop("_no")


def sessions(events: DataFrame, key: str, at: str, gap_us: int, span_us: int = 86_400_000_000, distinct: bool = False) -> DataFrame:
    """(key, start_us, end_us, duration_us, n_events) of every session of ``key``.

    ``at`` is an instant in micros; silences longer than ``gap_us`` part sessions, exactly ``gap_us`` doesn't.
    Rows with null key or instant take part in none; rows of one key and instant count as one event; an empty
    table has no sessions. ``distinct``: the caller's rows are known to differ by key and instant, which saves looking for
    copies (sessions are the same with copies, their counts are not). A key's fragments are at most its spans plus its sessions, whatever its rows.
    """
    rows = events.select(F.col(key).alias("_k"), F.col(at).alias("s")).where("_k is not null and s is not null")
    rows = rows.withColumn("span", F.floor(F.col("s") / span_us))
    one = F.lit(1).cast("bigint").alias("n")
    rows = rows.select("*", one) if distinct else rows.groupBy("_k", "span", "s").agg(one)
    parts = sweep(rows.withColumn("e", F.col("s")), ["_k", "span"], gap_us)
    whole = sweep(parts.select("_k", F.col("start_us").alias("s"), F.col("end_us").alias("e"), F.col("n_events").alias("n")), ["_k"], gap_us)
    return whole.select(F.col("_k").alias(key), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events")


def session_of(rows: DataFrame, found: DataFrame, key: str, at: str, span: str, span_us: int) -> DataFrame:
    """``rows`` and ``session_us``, the start of the session of ``found`` in which each lies (null: none).

    Sessions meet rows by key and span, each span with the list of the sessions that touch it; that
    list has at most span_us / gap + 2 entries, since sessions are a gap apart.
    """
    touched = F.explode(F.sequence(F.floor(F.col("start_us") / span_us), F.floor(F.col("end_us") / span_us)))
    lists = found.select(F.col(key).alias("__key"), touched.alias("__span"), "start_us").groupBy("__key", "__span").agg(F.sort_array(F.collect_list("start_us")).alias("__starts"))
    joined = rows.join(lists, (F.col(key) == F.col("__key")) & (F.col(span) == F.col("__span")), "left")
    # lists are short: the last start that isn't after the row
    mine = F.expr(f"array_max(filter(__starts, x -> x <= `{at}`))")
    return joined.withColumn("session_us", mine).drop("__key", "__span", "__starts")
