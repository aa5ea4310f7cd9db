"""Mixed timestamp notations and zones brought to one instant.

Every value becomes the array of its valid readings, each with a cost; Viterbi over the record order of each
source (feed and device) picks one reading per row, at a price for a change of notation and for a step back
in time. Null, blank and meaningless values have no reading and come out unreadable (null instant).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import is_canonical, readings, trimmed
from ..shared import stage
from .grouped import map_groups

#: Price of a change of notation, and of a step back in time by more than BACK_US.
SWITCH, BACK, BACK_US = 1.0, 2.0, 3_600_000_000
#: A row takes part in two steps of a path: its choice saves at most so much elsewhere.
SLACK = 2 * (SWITCH + BACK)
#: Rows of a source are searched in runs of so many arrivals, so that no source is one task; paths go on across the seams.
CHUNK = 1 << 20

_NEVER = np.iinfo(np.int64).max


def _with_rules(pings: DataFrame, feeds: DataFrame, *columns: str) -> DataFrame:
    """Rows with the rules of their feed: of its first row by zone if it has several, none if it is unknown."""
    rules = feeds.groupBy(F.col("feed_id").alias("_feed")).agg(F.min(F.struct("time_zone", "date_order")).alias("_rule"))
    joined = pings.join(rules, F.col("feed_id") == F.col("_feed"), "left")
    return joined.select(
        *columns, F.col("timestamp").alias("_text"), F.col("_rule.time_zone").alias("_zone"), F.col("_rule.date_order").alias("_order"),
        F.unix_micros(F.col("received_at").cast("timestamp")).alias("_got"),
    )


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = b.column("_got").fill_null(_NEVER).to_numpy(zero_copy_only=False)
    return readings(b.column("_text"), b.column("_zone"), b.column("_order"), got)


_OWN = ("_text", "_zone", "_order", "_got")


def _passed(b: pa.RecordBatch) -> dict[str, pa.Array]:
    return {k: b.column(k) for k in b.schema.names if k not in _OWN}


def viterbi(cost: np.ndarray, us: np.ndarray, fmt: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the reading chosen for each row, -1 for none.

    Readings of row i are offsets[i]..offsets[i+1]; starts are the rows at which sources begin. Rows without
    a reading are passed over. A row with one reading is a fixed point: paths are searched between them.
    """
    count = np.diff(offsets)
    pick = np.where(count > 0, offsets[:-1], -1)
    new = np.zeros(len(count), dtype=bool)
    new[starts] = True
    rows = np.flatnonzero(count > 0)
    at = np.flatnonzero(count[rows] > 1)
    if not len(at):
        return pick
    source = np.cumsum(new)[rows]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = source[1:] != source[:-1]
    # stretches of rows with several readings, adjacent in one source
    cut = np.flatnonzero((np.diff(at) > 1) | first[at[1:]]) + 1
    lows, highs = at[np.r_[0, cut]].tolist(), at[np.r_[cut - 1, len(at) - 1]].tolist()
    for lo, hi in zip(lows, highs):
        a = lo if first[lo] else lo - 1
        z = hi + 1 if hi + 1 < len(rows) and not first[hi + 1] else hi
        back: list[list[int]] = []
        prev: list[tuple[float, int, int]] = []
        for i in range(a, z + 1):
            row = rows[i]
            now, via = [], []
            for k in range(offsets[row], offsets[row + 1]):
                t, f = int(us[k]), int(fmt[k])
                best, origin = 0.0, -1
                for j, (c, pt, pf) in enumerate(prev):
                    step = c + SWITCH * (pf != f) + BACK * (pt - t > BACK_US)
                    if origin < 0 or step < best:
                        best, origin = step, j
                now.append((best + cost[k], t, f))
                via.append(origin)
            back.append(via)
            prev = now
        j = min(range(len(prev)), key=lambda i: (prev[i][0], prev[i][1]))
        for i in range(z, a - 1, -1):
            pick[rows[i]] = offsets[rows[i]] + j
            j = back[i - a][j]
    return pick


def _lists(table: pa.Table) -> tuple[np.ndarray, pa.StructArray]:
    lists = table.column("readings").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.offsets.to_numpy().astype(np.int64), lists.values


def _chosen(table: pa.Table, starts: np.ndarray) -> pa.Array:
    """The instant of each row by Viterbi, null where it has no reading."""
    offsets, flat = _lists(table)
    cost, us, fmt = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("cost", "us", "fmt"))
    pick = viterbi(cost, us, fmt, offsets, starts)
    instant = np.zeros(len(pick), dtype=np.int64)
    instant[pick >= 0] = us[pick[pick >= 0]]
    return pa.array(instant, mask=pick < 0)


OPEN, FIXED = 1, 2
_SEAM = "seam int, f string, v string, readings array<struct<cost:double,us:bigint,fmt:int>>"


def _within(table: pa.Table, starts: np.ndarray) -> pa.Table:
    """What the rows of one run decide alone; rows beyond its first and last fixed point go on to the seams, with those points."""
    offsets, _ = _lists(table)
    count = np.diff(offsets)
    n = len(count)
    done = _chosen(table, starts)
    seam = np.zeros(n, dtype=np.int32)
    points: list[int] = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n]):
        fixed = a + np.flatnonzero(count[a:b] == 1)
        lo, hi = (int(fixed[0]), int(fixed[-1])) if len(fixed) else (b, b - 1)
        seam[a:lo][count[a:lo] > 1] = OPEN
        if len(fixed):
            seam[hi + 1 : b][count[hi + 1 : b] > 1] = OPEN
            points.extend({lo, hi})
    rows = np.r_[np.arange(n), np.array(sorted(points), dtype=np.int64)]
    seams = np.r_[seam, np.full(len(points), FIXED, dtype=np.int32)]
    take = lambda a: (a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a).take(pa.array(rows))
    drop = pa.array(seams == 0)
    null = lambda a: pc.if_else(drop, pa.scalar(None, a.type), a)
    held = np.flatnonzero(seams > 0)
    back = np.full(len(rows), -1, dtype=np.int64)
    back[held] = np.arange(len(held))
    lists = take(table.column("readings")).take(pa.array(held)).take(pa.array(back, mask=back < 0))
    passed = {k: take(table.column(k)) for k in table.schema.names if k.startswith("_c")}
    return pa.table({"id": take(table.column("id")), **passed, "instant_us": take(done), "canonical": take(table.column("canonical")), "seam": seams, "f": null(take(table.column("f"))), "v": null(take(table.column("v"))), "readings": lists})


def _across(table: pa.Table, starts: np.ndarray) -> pa.Table:
    own = np.asarray(table.column("seam").to_numpy()) == OPEN
    passed = {k: table.column(k) for k in table.schema.names if k.startswith("_c")}
    out = pa.table({"id": table.column("id"), **passed, "instant_us": _chosen(table, starts), "canonical": table.column("canonical")})
    return out.filter(pa.array(own))


def with_readings(pings: DataFrame, feeds: DataFrame, *columns: str) -> DataFrame:
    """(id, f, v, chunk, canonical, readings, _c0, ...): all valid readings of every row, as array<struct<cost,us,fmt>>;
    ``columns`` of the row go along as _c0 and so on."""
    rows = pings.withColumns({
        "f": F.col("feed_id"), "v": trimmed(F.col("vehicle_id")), "chunk": F.floor(F.col("id") / CHUNK),
        "canonical": F.coalesce(is_canonical(F.col("timestamp")), F.lit(False)), **{f"_c{i}": F.col(c) for i, c in enumerate(columns)},
    })
    passed = [f"_c{i}" for i in range(len(columns))]
    kinds = "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in passed)
    rows = _with_rules(rows, feeds, "id", "f", "v", "chunk", "canonical", *passed)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, cost, fmt = _read(b)
            has = np.isfinite(cost)
            offsets = np.r_[0, np.cumsum(has.sum(axis=1))].astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(cost[has]), pa.array(us[has]), pa.array(fmt[has])], ["cost", "us", "fmt"])
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
            yield pa.RecordBatch.from_pydict(_passed(b) | {"readings": lists})

    schema = f"id bigint, f string, v string, chunk bigint, canonical boolean{kinds}, readings array<struct<cost:double,us:bigint,fmt:int>>"
    return rows.mapInArrow(kernel, schema)


def normalise(pings: DataFrame, feeds: DataFrame, *columns: str) -> DataFrame:
    """(id, *columns, instant_us, canonical) of every row: the instant it denotes or null, by Viterbi per source.

    canonical: the value is already written as yyyy-MM-ddTHH:mm:ss[.f]Z. Rows with equal ids each come out. A
    source is a feed's device. Each run of CHUNK arrivals is searched apart as far as its first and last row with one
    reading reach: those are fixed points, on either side of which paths don't depend on each other. What lies
    beyond them meets the neighbouring runs in a second search over the source, so seams change no path.
    """
    rows = with_readings(pings, feeds, *columns)
    passed = [f"_c{i}" for i in range(len(columns))]
    shape = "id bigint" + "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in passed) + ", instant_us bigint, canonical boolean"
    parts = stage(map_groups(rows, ["f", "v", "chunk"], ["id"], _within, f"{shape}, {_SEAM}"), "paths")
    rest = map_groups(parts.where("seam > 0").drop("instant_us"), ["f", "v"], ["id"], _across, shape)
    out = ["id", *[F.col(k).alias(c) for k, c in zip(passed, columns)], "instant_us", "canonical"]
    return parts.where("seam = 0").select("id", *passed, "instant_us", "canonical").unionByName(rest).select(*out)


def settled(pings: DataFrame, feeds: DataFrame, *columns: str) -> DataFrame:
    """(*columns, instant_us, settled): the cheapest reading, and whether no path could choose another.

    Where the next reading costs over SLACK more, or there is none, Viterbi must return the cheapest one.
    """
    rows = _with_rules(pings, feeds, *columns)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, cost, _ = _read(b)
            best = cost.argmin(axis=1)
            each = np.arange(len(us))
            least = cost[each, best]
            sure = (cost <= (least + SLACK)[:, None]).sum(axis=1) == 1
            none = ~np.isfinite(least)
            out = {"instant_us": pa.array(us[each, best], mask=none), "settled": pa.array(sure | none)}
            yield pa.RecordBatch.from_pydict(_passed(b) | out)

    kept = pings.select(*columns).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "instant_us bigint", "settled boolean"])
    return rows.mapInArrow(kernel, schema)
