"""Stationary runs by anchor: a ping joins the run while within the radius of its first ping."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.geo import EARTH_M
from .grouped import map_streams


Anchor = tuple[int, float, float, float]


def anchored(x: list[float], y: list[float], radius: float, projected: bool, at: Anchor | None = None) -> tuple[list[int], Anchor | None]:
    """Run number of each point: within ``radius`` (at most) of the first point of the run; and the last run with its anchor.

    at: run and anchor with which the points before ended, None at the beginning; runs count from 0.
    """
    out = []
    run, ax, ay, c = at if at is not None else (-1, 0.0, 0.0, 0.0)
    for i in range(len(x)):
        if x[i] is None or y[i] is None or x[i] != x[i] or y[i] != y[i]:  # goes with the run before
            out.append(max(run, 0))
            continue
        if run >= 0:
            if projected:
                d = math.hypot(x[i] - ax, y[i] - ay)
            else:
                a1, a2 = math.radians(ax), math.radians(x[i])
                h = math.sin((a2 - a1) / 2) ** 2 + c * math.cos(a2) * math.sin(math.radians(y[i] - ay) / 2) ** 2
                d = 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))
        if run < 0 or d > radius:
            run += 1
            ax, ay = x[i], y[i]
            c = math.cos(math.radians(ax))
        out.append(run)
    return out, (run, ax, ay, c) if run >= 0 else None


def dwell_runs(pings: DataFrame, radius: float, projected: bool = False) -> DataFrame:
    """(vehicle_id, _s, t, _ord, id, latitude, longitude, run) of every ping, runs numbered from 0 in its session.

    A ping without coordinates (null or NaN) goes with the run before it. Sequential by nature, hence a kernel that goes through each session in order; from batch to batch it keeps the anchor only, so
    a session of any length takes the memory of one batch.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pings.schema.fields}
    names = ["vehicle_id", "_s", "t", "_ord", "id", "latitude", "longitude"]
    schema = ", ".join(f"{k} {kinds[k]}" for k in names) + ", run bigint"

    def step(table: pa.Table, starts: np.ndarray, at: object) -> tuple[pa.Table, object]:
        x, y = (table.column(k).cast(pa.float64()).to_pylist() for k in ("latitude", "longitude"))
        run: list[int] = []
        cuts = [0, *(c for c in starts.tolist() if c), len(x)]
        if len(starts) and starts[0] == 0:
            at = None
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            own, at = anchored(x[a:b], y[a:b], radius, projected, None if n else at)
            run.extend(own)
        return pa.table({k: table.column(k) for k in names} | {"run": pa.array(run, pa.int64())}), at

    return map_streams(pings.select(*names), ["vehicle_id", "_s"], ["t", "_ord"], step, schema)
