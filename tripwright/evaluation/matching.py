"""Predicted trip segments matched one to one to true ones, by overlap in time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import blank
from ..operators.grouped import map_groups
from ..operators.sessions import session_of, sweep
from ..shared import stage

GROUP = ("vehicle_id", "route_id")
SPAN_US = 86_400_000_000


def checked(segments: DataFrame, name: str) -> DataFrame:
    """Segments with a unique, non-blank seg_id, start_us and end_us; else ValueError."""
    empty = blank(F.col("seg_id")) | F.col("seg_id").cast("string").rlike(r"^\s*$")
    bad, n, d = segments.agg(F.count_if(empty), F.count("*"), F.count_distinct("seg_id")).first()
    if bad:
        raise ValueError(f"{bad} rows of {name} have no seg_id")
    if n != d:
        raise ValueError(f"{name} repeats seg_ids")
    return segments


def segment_sessions(pred: DataFrame, truth: DataFrame, gap_us: int) -> DataFrame:
    """(vehicle_id, route_id, start_us, end_us, n_events): unions of segments of either kind at most ``gap_us`` apart.

    Segments are united within days first, so that a hot vehicle is many tasks.
    """
    rows = _both(pred, truth, gap_us).select(*GROUP, "_span", F.col("start_us").alias("s"), F.col("end_us").alias("e"), F.lit(1).cast("bigint").alias("n"))
    parts = sweep(rows, [*GROUP, "_span"], gap_us)
    return sweep(parts.select(*GROUP, F.col("start_us").alias("s"), F.col("end_us").alias("e"), F.col("n_events").alias("n")), list(GROUP), gap_us)


def _both(pred: DataFrame, truth: DataFrame, gap_us: int) -> DataFrame:
    """Segments of both kinds in one table, with the span of time in which each begins."""
    columns = [*GROUP, "seg_id", "start_us", "end_us"]
    both = pred.select(*columns, F.lit(True).alias("is_pred")).unionByName(truth.select(*columns, F.lit(False).alias("is_pred")))
    return both.withColumn("_span", F.floor(F.col("start_us") / max(SPAN_US, gap_us)))


_PAIR = "session_us bigint, pred_id string, truth_id string, pred_start bigint, pred_end bigint, truth_start bigint, truth_end bigint, iou double, of_pred bigint, of_truth bigint, chosen boolean"


def overlaps(pred: DataFrame, truth: DataFrame, gap_us: int) -> DataFrame:
    """Pairs of one vehicle, route and session that overlap in time: ids and bounds of both, iou above 0, how many pairs
    either side is in (of_pred, of_truth), and whether the assignment of greatest total iou chose the pair.

    Null vehicles and routes match nothing. One kernel a session takes its segments of both kinds.
    """
    known = F.col("vehicle_id").isNotNull() & F.col("route_id").isNotNull()
    rows = _both(pred.where(known), truth.where(known), gap_us).withColumn("_g", F.struct(*GROUP))
    found = segment_sessions(pred.where(known), truth.where(known), gap_us).withColumn("_g", F.struct(*GROUP)).select("_g", "start_us", "end_us")
    rows = session_of(rows, found, "_g", "start_us", "_span", max(SPAN_US, gap_us))
    rows = rows.select(*GROUP, "session_us", "is_pred", F.col("seg_id").cast("string").alias("seg_id"), "start_us", "end_us")
    own = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in GROUP)
    return map_groups(rows, [*GROUP, "session_us"], ["is_pred", "start_us", "end_us", "seg_id"], _kernel, f"{own}, {_PAIR}")


def best_assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total weight; only positive weights match, any may stay alone. Exact."""
    rows, cols = weights.shape
    n = rows + cols  # each row may take a place of its own at no gain
    cost = np.zeros((rows, n))
    cost[:, :cols] = -np.maximum(weights, 0.0)
    u, v = np.zeros(rows), np.zeros(n)
    owner = np.full(n, -1)
    for r in range(rows):
        dist, via = np.full(n, np.inf), np.full(n, -1)
        done = np.zeros(n, bool)
        row, col, reach = r, -1, 0.0
        while True:
            slack = reach + cost[row] - u[row] - v
            better = ~done & (slack < dist - 1e-15)
            dist[better], via[better] = slack[better], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            reach, done[col] = dist[col], True
            if owner[col] < 0:
                break
            row = owner[col]
        u[r] += reach
        for c in np.flatnonzero(done):
            if c != col and owner[c] >= 0:
                u[owner[c]] += reach - dist[c]
            v[c] -= reach - dist[c]
        while col >= 0:
            before = via[col]
            owner[col] = r if before < 0 else owner[before]
            col = before
    return [(int(owner[c]), c) for c in range(cols) if owner[c] >= 0 and weights[owner[c], c] > 0]


def components(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Edges (a[i], b[i]) by connected component, as lists of edge numbers."""
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def root(x: tuple[int, int]) -> tuple[int, int]:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        parent[root((0, x))] = root((1, y))
    by: dict[tuple[int, int], list[int]] = {}
    for i, x in enumerate(a.tolist()):
        by.setdefault(root((0, x)), []).append(i)
    return [np.array(x) for x in by.values()]


def _crossing(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all intervals a and b that share more than a point; b by rising start."""
    low = np.searchsorted(np.maximum.accumulate(b1), a0, side="right") if len(b1) else np.zeros(len(a0), np.int64)
    size = np.maximum(np.searchsorted(b0, a1, side="left") - low, 0)
    i = np.repeat(np.arange(len(a0)), size)
    j = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    ok = np.minimum(a1[i], b1[j]) > np.maximum(a0[i], b0[j])
    return i[ok], j[ok]


def _kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
    start, end = table.column("start_us").to_numpy(), table.column("end_us").to_numpy()
    is_pred = table.column("is_pred").to_numpy(zero_copy_only=False)
    pred, truth, of_pred, of_truth, chosen, iou = [], [], [], [], [], []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(start)]):
        t = np.arange(s, e)[~is_pred[s:e]]
        p = np.arange(s, e)[is_pred[s:e]]
        a, b = _crossing(start[p], end[p], start[t], end[t])
        if not len(a):
            continue
        inter = np.minimum(end[p[a]], end[t[b]]) - np.maximum(start[p[a]], start[t[b]])
        w = inter / ((end[p[a]] - start[p[a]]) + (end[t[b]] - start[t[b]]) - inter)
        won = np.zeros(len(a), dtype=bool)
        for edges in components(a, b):
            if len(edges) == 1:
                won[edges] = True
                continue
            ra, ia = np.unique(a[edges], return_inverse=True)
            rb, ib = np.unique(b[edges], return_inverse=True)
            m = np.zeros((len(ra), len(rb)))
            at = np.full(m.shape, -1)
            m[ia, ib], at[ia, ib] = w[edges], edges
            won[[at[i, j] for i, j in best_assignment(m)]] = True
        pred.append(p[a]), truth.append(t[b]), iou.append(w), chosen.append(won)
        of_pred.append(np.bincount(a)[a]), of_truth.append(np.bincount(b)[b])
    flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    i, j = flat(pred, np.int64), flat(truth, np.int64)
    ids = table.column("seg_id")
    return pa.table({k: table.column(k).take(pa.array(i)) for k in (*GROUP, "session_us")} | {
        "pred_id": ids.take(pa.array(i)), "truth_id": ids.take(pa.array(j)), "pred_start": start[i], "pred_end": end[i], "truth_start": start[j], "truth_end": end[j],
        "iou": flat(iou, float), "of_pred": flat(of_pred, np.int64), "of_truth": flat(of_truth, np.int64), "chosen": flat(chosen, bool),
    })


@dataclass
class Matches:
    """matches: one row a matched pair; counts: one row of n_pred, n_truth, splits (truths under several
    predictions) and merges (predictions over several truths)."""

    matches: DataFrame
    counts: DataFrame


def match_segments(pred: DataFrame, truth: DataFrame, gap_us: int = 14_400_000_000) -> Matches:
    """The one-to-one matching of greatest total IoU in each vehicle, route and session.

    Both tables: seg_id, vehicle_id, route_id, start_us, end_us; blank or repeated seg_ids raise ValueError, as the joins
    on them would multiply rows. A pair is clean if neither side overlaps another segment. Null vehicles and routes
    match nothing. Sessions bound what one task holds.
    """
    pred, truth = checked(pred, "pred"), checked(truth, "truth")
    pairs = stage(overlaps(pred, truth, gap_us), "pairs")
    seconds = lambda a, b: (F.col(a) - F.col(b)) / 1e6
    m = pairs.where("chosen").select(
        "iou", "pred_id", "truth_id", *GROUP,
        F.abs(seconds("pred_start", "truth_start")).alias("boundary_start_err"), F.abs(seconds("pred_end", "truth_end")).alias("boundary_end_err"),
        ((F.col("of_pred") == 1) & (F.col("of_truth") == 1)).alias("clean"),
        seconds("truth_end", "truth_start").alias("truth_dur"), seconds("pred_end", "pred_start").alias("pred_dur"),
    )
    some = pairs.agg(
        F.count_distinct(F.when(F.col("of_truth") > 1, F.col("truth_id"))).alias("splits"), F.count_distinct(F.when(F.col("of_pred") > 1, F.col("pred_id"))).alias("merges")
    )
    counts = pred.agg(F.count("*").alias("n_pred")).join(truth.agg(F.count("*").alias("n_truth")), how="inner").join(some, how="inner")
    return Matches(m, counts)
