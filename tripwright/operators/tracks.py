"""Per device track: implausible readings, and stops and trips, in one pass over sessions.

Implausible readings: a Kalman filter per session and channel forecasts the reading: the position by a random walk whose
step is the device's usual moving speed, the speed by a state that falls back to rest. A standardised innovation above the
threshold is flagged and its update withheld; a stretch of positions stands if the track comes back only by a jump of
the same kind, a speed if it is TIMES the usual one. A channel the variance of whose innovations vanishes over a window,
while there is motion, is stuck. What is no coordinate or no speed at all is no measurement and flagged as such. Stops and
trips: stay points of the readings that remain, from an anchor window that grows while it is within the radius.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, haversine_m
from .grouped import map_groups
from .pings import SPAN_US
from .sessions import sessions

#: A reading is implausible beyond so many times the usual moving speed.
TIMES = 3.0
#: A stretch off the path is the new place of a device that could have gone there so many times over.
DOUBT = 4.0
#: Standard deviation of a position reading, metres.
NOISE_M = 10.0
#: Rows with the very same reading that make a channel stuck.
STUCK_ROWS = 10
#: The speed's filter, in usual speeds: the share that lasts to the next reading, the standard deviations of its change
#: and of a reading; innovations beyond so many standard deviations are withheld.
LASTS, CHANGE, READING, BEYOND = 0.5, 0.5, 0.25, 2.3
#: Reported moving speeds from which their median counts; steps up to so long are preferred to longer ones.
MIN_REPORTS, SHORT_US = 20, 120_000_000
#: Speeds above show motion, m/s; below the lower one a device stands.
MOVING, STANDING = 1.0, 0.25
GAP_US = 14_400_000_000
RADIUS_M, MIN_STOP_US, TRIP_M = 50.0, 600_000_000, 500.0


def usual_speed(rows: DataFrame, min_reports: int = MIN_REPORTS) -> DataFrame:
    """(vehicle_id, usual): median moving speed: by reported speeds if there are ``min_reports``, else by steps of at most
    SHORT_US, else by the fewer reports, else by longer steps.

    Counts per bin of 0.1 m/s are summed before they move, so a vehicle is at most 2,000 rows a kind whatever its pings.
    """
    binned = lambda df, v, kind: df.groupBy("vehicle_id", F.lit(kind).alias("kind"), F.floor(v * 10).alias("bin")).agg(F.count("*").alias("n"))
    reported = binned(rows.where((F.col("speed") > MOVING) & (F.col("speed") < 200)), F.col("speed"), 2)
    enough = reported.groupBy("vehicle_id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_reports).select("vehicle_id")
    silent = rows.select("vehicle_id", "span", "t", "latitude", "longitude").join(enough, "vehicle_id", "left_anti").where(valid_position())
    w = Window.partitionBy("vehicle_id", "span").orderBy("t")
    step = haversine_m(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    speed = step / ((F.col("t") - F.lag("t").over(w)) / 1e6)
    steps = silent.select("vehicle_id", speed.alias("v"), (F.col("t") - F.lag("t").over(w)).alias("dt"))
    steps = steps.where((F.col("v") > 2 * MOVING) & (F.col("v") < 200) & (F.col("dt") > 0))
    derived = steps.groupBy("vehicle_id", F.when(F.col("dt") <= SHORT_US, 1).otherwise(3).alias("kind"), F.floor(F.col("v") * 10).alias("bin")).agg(F.count("*").alias("n"))
    bins = reported.join(enough.withColumn("_enough", F.lit(True)), "vehicle_id", "left").select("vehicle_id", F.when(F.col("_enough"), 0).otherwise(F.col("kind")).alias("kind"), "bin", "n")
    bins = bins.unionByName(derived).withColumn("_best", F.min("kind").over(Window.partitionBy("vehicle_id"))).where("kind = _best")
    by_bin = Window.partitionBy("vehicle_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumn("up_to", F.sum("n").over(by_bin)).withColumn("all", F.sum("n").over(Window.partitionBy("vehicle_id")))
    return ranked.where(F.col("up_to") * 2 >= F.col("all")).groupBy("vehicle_id").agg(((F.min("bin") + 0.5) / 10).alias("usual"))


def valid_position():  # noqa: ANN201
    """Both coordinates there, neither zero, in range."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return lat.isNotNull() & lon.isNotNull() & (lat != 0) & (lon != 0) & lat.between(-90, 90) & lon.between(-180, 180)


def with_sessions(rows: DataFrame) -> DataFrame:
    """Kept rows with ``session_us`` and ``usual`` (null: the vehicle was never seen to move)."""
    found = sessions(rows, "vehicle_id", "t", GAP_US, distinct=True).join(usual_speed(rows), "vehicle_id", "left")
    touched = F.explode(F.sequence(F.floor(F.col("start_us") / SPAN_US), F.floor(F.col("end_us") / SPAN_US)))
    lists = found.select(F.col("vehicle_id").alias("_k"), touched.alias("_span"), "start_us", "usual")
    lists = lists.groupBy("_k", "_span").agg(F.collect_list("start_us").alias("_starts"), F.first("usual").alias("usual"))
    joined = rows.join(lists, (F.col("vehicle_id") == F.col("_k")) & (F.col("span") == F.col("_span")))
    return joined.withColumn("session_us", F.expr("array_max(filter(_starts, x -> x <= t))")).drop("_k", "_span", "_starts")


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and lengths of runs, given where one begins."""
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(new)])


def _metres(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """East and north of the middle reading, metres."""
    lat0, lon0 = np.sort(lat)[len(lat) // 2], np.sort(lon)[len(lon) // 2]
    east = (lon - lon0 + 540.0) % 360.0 - 180.0
    k = math.radians(1.0) * EARTH_M
    return east * (k * math.cos(math.radians(lat0))), (lat - lat0) * k


def off_path(t: np.ndarray, x: np.ndarray, y: np.ndarray, usual: float) -> list[int]:
    """Rows off the path: the filter's innovation is beyond TIMES when they come and when they are left.

    t in seconds, rising; x, y in metres. A stretch that is reached by a jump but left at leave, or
    never left, is the device's new place: the filter starts again there and flags nothing. It is in doubt until the device
    could have gone its distance from the path DOUBT times over: within that time a jump back still settles it.
    """
    limit, noise = TIMES * TIMES, NOISE_M * NOISE_M
    ts, xs, ys = t.tolist(), x.tolist(), y.tolist()
    flagged: list[int] = []
    i, n = 1, len(ts)
    px, py, pt, var = xs[0], ys[0], ts[0], noise
    away = -1  # first row of the stretch whose updates are withheld
    while i < n:
        dx, dy = xs[i] - px, ys[i] - py
        q = usual * (ts[i] - pt)
        prior = var + q * q
        s = prior + noise
        if dx * dx + dy * dy > limit * s:
            if away < 0:
                away = i
            i += 1
            if i == n:  # never left
                i = away
                px, py, pt, var, away = xs[i], ys[i], ts[i], noise, -1
                i += 1
            continue
        if away >= 0:
            lx, ly = xs[i] - xs[i - 1], ys[i] - ys[i - 1]
            q2 = usual * (ts[i] - ts[i - 1])
            if lx * lx + ly * ly > limit * (q2 * q2 + 2 * noise):
                flagged.extend(range(away, i))
                away = -1
            elif i + 1 < n and DOUBT * DOUBT * (dx * dx + dy * dy) > limit * s:
                i += 1
                continue
            else:
                i = away
                px, py, pt, var, away = xs[i], ys[i], ts[i], noise, -1
                i += 1
                continue
        gain = prior / s
        px += gain * dx
        py += gain * dy
        pt, var = ts[i], (1.0 - gain) * prior
        i += 1
    return flagged


def off_pace(speed: list[float], usual: float) -> list[int]:
    """Rows whose speed is further above the filter's forecast than BEYOND standard deviations; NaN readings are passed over.

    In usual speeds the state never exceeds 2.44, so a forecast is at most 1.22, and the limit at most 1.45: every reading
    above TIMES = 3 is among the rows.
    """
    flagged: list[int] = []
    limit, lasts2, change2, reading2 = BEYOND * BEYOND, LASTS * LASTS, CHANGE * CHANGE, READING * READING
    m, var = 0.0, change2 / (1 - lasts2)
    for i, v in enumerate(speed):
        m *= LASTS
        var = lasts2 * var + change2
        if v != v:
            continue
        s = var + reading2
        e = v / usual - m
        if e > 0 and e * e > limit * s:
            flagged.append(i)
            continue
        gain = var / s
        m += gain * e
        var *= 1 - gain
    return flagged


def vanished(square: np.ndarray) -> np.ndarray:
    """Rows in a window of STUCK_ROWS - 1 innovations whose variance is nothing.

    square: squared innovations of a random walk read without noise (change since the row before), inf where there is none.
    """
    k = STUCK_ROWS - 1
    n = len(square)
    if n < k:
        return np.zeros(n, dtype=bool)
    ends = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(square, k).sum(axis=1) == 0.0)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, ends, 1)
    np.add.at(edge, ends + k, -1)
    return np.cumsum(edge[:n]) > 0


def implausible(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, speed: np.ndarray, usual: np.ndarray, starts: np.ndarray, speeds: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(position can't be true, speed can't be true) of rows in sessions that begin at ``starts``; NaN: no reading.

    Without ``speeds`` only the former is looked for.
    """
    n = len(t)
    head = np.zeros(n, dtype=bool)
    head[starts] = True
    ends = np.r_[starts[1:], n]
    with np.errstate(invalid="ignore"):
        has = ~np.isnan(lat) & ~np.isnan(lon)
        bad = has & ((lat == 0) | (lon == 0) | (np.abs(lat) > 90) | (np.abs(lon) > 180))
        fast = speed < 0
        square = lambda *xs: np.where(head, np.inf, np.nan_to_num(sum((x - np.r_[np.nan, x[:-1]]) ** 2 for x in xs), nan=np.inf, posinf=np.inf))
        still = vanished(square(lat, lon))
        if speeds:
            fast |= vanished(square(speed)) & (speed > 0)
    frozen = np.zeros(n, dtype=bool)
    first, length = _runs(still != np.r_[False, still[:-1]])
    for a, k in zip(first[still[first]] - 1, length[still[first]] + 1):
        # the series is stuck as far as its speeds show motion
        with np.errstate(invalid="ignore"):
            own = np.where(np.abs(speed[a : a + k]) <= TIMES * usual[a], speed[a : a + k], np.nan)
        stand = np.flatnonzero(own > STANDING)
        if not len(stand):
            continue
        # rows in which it stands before and after are no part of the series
        lo, hi = int(stand[0]), int(stand[-1])
        while lo > 0 and np.isnan(own[lo - 1]):
            lo -= 1
        while hi + 1 < k and np.isnan(own[hi + 1]):
            hi += 1
        if lo and not np.isnan(own[:lo]).all() and np.isnan(own[lo]):
            lo = int(stand[0])
        if hi - lo + 1 >= STUCK_ROWS and np.nanmean(own[lo : hi + 1]) > MOVING:
            frozen[a + lo + 1 : a + hi + 1] = True
    good = has & ~bad & ~frozen
    off = np.zeros(n, dtype=bool)
    # below this no innovation of a speed can be beyond the limit
    low = BEYOND * math.sqrt(CHANGE * CHANGE + READING * READING)
    for a, b in zip(starts, ends):
        u = float(usual[a])
        if not u > 0:
            continue
        if speeds:
            own = np.where(speed[a:b] >= 0, speed[a:b], np.nan)
            if (own > low * u).any():
                beyond = a + np.array(off_pace(own.tolist(), u), dtype=np.int64)
                fast[beyond[speed[beyond] > TIMES * u]] = True
        rows = a + np.flatnonzero(good[a:b])
        if len(rows) < 3:
            continue
        x, y = _metres(lat[rows], lon[rows])
        out = off_path((t[rows] - t[a]) / 1e6, x, y, u)
        off[rows[out]] = True
    return bad | frozen | off, fast


def stays(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """(first, last row) of each stop in a track: at least MIN_STOP_US within RADIUS_M of one place, longest each.

    An anchor window grows while its rows are within the radius of the anchor; once it lasts long enough, the
    median of its rows is the place, and the window grows both ways while rows are within the radius of it.
    """
    n, r2 = len(t), RADIUS_M * RADIUS_M
    found: list[tuple[int, int]] = []
    ts, xs, ys = t.tolist(), x.tolist(), y.tolist()
    free = i = 0  # rows before ``free`` belong to a stop
    while i < n:
        ax, ay = xs[i], ys[i]
        j = i + 1
        while j < n and (xs[j] - ax) ** 2 + (ys[j] - ay) ** 2 <= r2:
            j += 1
        if ts[j - 1] - ts[i] < MIN_STOP_US:
            i += 1
            continue
        lo, hi = i, j - 1
        before: set[tuple[int, int]] = set()
        while (lo, hi) not in before:  # until it stays as it is, or comes round
            before.add((lo, hi))
            cx, cy = float(np.median(x[lo : hi + 1])), float(np.median(y[lo : hi + 1]))
            near = lambda k: (xs[k] - cx) ** 2 + (ys[k] - cy) ** 2 <= r2  # noqa: B023, E731
            a, b = lo, hi
            while a < b and not near(a):
                a += 1
            while b > a and not near(b):
                b -= 1
            while a > free and near(a - 1):
                a -= 1
            while b + 1 < n and near(b + 1):
                b += 1
            lo, hi = a, b
        if ts[hi] - ts[lo] >= MIN_STOP_US:
            found.append((lo, hi))
            free = i = max(hi, i) + 1
        else:
            i += 1
    return found


_FLAGS = "id bigint, field string"
_MOVES = "kind string, vehicle_id string, start_us bigint, end_us bigint, duration_us bigint, distance_m double, n_pings bigint"


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as numpy; numbers that are null come as NaN."""
    return [table.column(k).to_numpy() for k in names]


def _flag_kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
    ids, t, lat, lon, speed, usual = _columns(table, "id", "t", "latitude", "longitude", "speed", "usual")
    where, fast = implausible(t, lat.astype(float), lon.astype(float), speed.astype(float), usual.astype(float), starts)
    fields = ["position"] * int(where.sum()) + ["speed"] * int(fast.sum())
    return pa.table({"id": np.r_[ids[where], ids[fast]], "field": pa.array(fields, pa.string())})


def _move_kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
    t, lat, lon, speed, usual = (c if k == 0 else c.astype(float) for k, c in enumerate(_columns(table, "t", "latitude", "longitude", "speed", "usual")))
    where, _ = implausible(t, lat, lon, speed, usual, starts, speeds=False)
    good = ~where & ~np.isnan(lat) & ~np.isnan(lon)
    vehicles = table.column("vehicle_id")
    out: list[tuple] = []
    for a, b in zip(starts, np.r_[starts[1:], len(t)]):
        rows = a + np.flatnonzero(good[a:b])
        if not len(rows):
            continue
        x, y = _metres(lat[rows], lon[rows])
        tt = t[rows]
        steps = np.r_[0.0, np.cumsum(np.hypot(np.diff(x), np.diff(y)))]
        v = vehicles[int(a)].as_py()
        at = 0
        for lo, hi in [*stays(tt, x, y), (len(rows) - 1, None)]:
            if lo > at and np.hypot(x[at : lo + 1] - x[at], y[at : lo + 1] - y[at]).max() > TRIP_M:
                out.append(("trip", v, tt[at], tt[lo], tt[lo] - tt[at], steps[lo] - steps[at], lo - at + 1))
            if hi is not None:
                out.append(("stop", v, tt[lo], tt[hi], tt[hi] - tt[lo], steps[hi] - steps[lo], hi - lo + 1))
                at = hi
    columns = list(zip(*out)) if out else [()] * 7
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _MOVES.split(", ")])


_TRACK = ["vehicle_id", "session_us", "t", "id", "latitude", "longitude", "speed", "usual"]


def implausible_readings(rows: DataFrame) -> DataFrame:
    """(id, field): every reading of the kept ``rows`` that can't be true, field 'position' or 'speed'.

    Null and NaN readings are none. A vehicle of which no motion is known has no usual speed: only
    impossible values and stuck speeds are flagged. An empty table flags nothing.
    """
    return map_groups(with_sessions(rows).select(*_TRACK), ["vehicle_id", "session_us"], ["t", "id"], _flag_kernel, _FLAGS)


def stops_and_trips(rows: DataFrame) -> DataFrame:
    """(kind, vehicle_id, start_us, end_us, duration_us, distance_m, n_pings) of all stops and trips of kept rows.

    Rows without both coordinates, or with an implausible position, take no part. A group is one session of one
    vehicle, so a hot vehicle is as many tasks as it has sessions.
    """
    return map_groups(with_sessions(rows).select(*_TRACK), ["vehicle_id", "session_us"], ["t", "id"], _move_kernel, _MOVES)
