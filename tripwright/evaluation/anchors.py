"""Discovered turnaround places against audited ones, and against scheduled stops."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.proximity import near, nearest_pairs
from .matching import best_assignment, components


@dataclass
class AnchorScore:
    precision: float | None
    recall: float | None
    tp: int
    n_discovered_kept: int
    n_truth: int
    n_dropped_low_support: int
    splits: int
    merges: int
    stability: float | None


def anchor_detection(discovered: DataFrame, truth: DataFrame, dist_tol: float = 150.0, min_recurrence: int = 3, min_coverage: float = 0.1) -> AnchorScore:
    """Precision and recall of clusters (anchor, latitude, longitude, recurrence, coverage) against true anchors
    (anchor, latitude, longitude), matched one to one within ``dist_tol`` for the greatest total closeness.

    Clusters of low support are counted and left out. Pairs within the distance come from the spatial join and are
    settled on the driver: they are at most as many as audited anchors have neighbours.
    """
    kept = discovered.where((F.col("recurrence") >= min_recurrence) & (F.col("coverage") >= min_coverage))
    n_all, n_kept, n_truth = discovered.count(), kept.count(), truth.count()
    base = AnchorScore(None, None, 0, n_kept, n_truth, n_all - n_kept, 0, 0, None)
    if not n_kept or not n_truth:
        base.precision = 0.0 if n_kept else None
        base.recall = 0.0 if n_truth else None
        return base
    pairs = near(kept.withColumn("a", F.col("anchor").cast("string")), truth.withColumn("b", F.col("anchor").cast("string")), dist_tol, "a", "b", valid=False).toPandas()
    a, ia = np.unique(pairs["a"].to_numpy(), return_inverse=True)
    b, ib = np.unique(pairs["b"].to_numpy(), return_inverse=True)
    w = dist_tol - pairs["metres"].to_numpy(float) + 1.0
    hits: list[str] = []
    for edges in components(ia, ib) if len(pairs) else []:
        ra, xa = np.unique(ia[edges], return_inverse=True)
        rb, xb = np.unique(ib[edges], return_inverse=True)
        m = np.zeros((len(ra), len(rb)))
        m[xa, xb] = w[edges]
        hits.extend(a[ra[i]] for i, _ in best_assignment(m))
    base.tp = len(hits)
    base.precision, base.recall = base.tp / n_kept, base.tp / n_truth
    base.splits = int((np.bincount(ib) > 1).sum()) if len(pairs) else 0
    base.merges = int((np.bincount(ia) > 1).sum()) if len(pairs) else 0
    if hits and {"n_groups_present", "n_groups_total"} <= set(kept.columns):
        base.stability = kept.where(F.col("anchor").cast("string").isin(hits)).agg(F.avg(F.col("n_groups_present") / F.col("n_groups_total"))).first()[0]
    return base


def stop_association(anchors: DataFrame, stops: DataFrame, dist_tol: float = 100.0) -> DataFrame:
    """(anchor, stop_id, distance_m, matched): the nearest stop of each anchor, its id only if within ``dist_tol``.

    Of equally near stops the first by id. distance_m is that of the nearest stop at any range; null only without a
    position or without stops.
    """
    at = F.concat_ws(" ", F.col("latitude").cast("double"), F.col("longitude").cast("double"))
    pairs = nearest_pairs(anchors.withColumn("_a", at), stops, "_a", "stop_id")
    best = pairs.groupBy("_a").agg(F.min(F.struct("metres", "stop_id")).alias("m"))
    out = anchors.select("anchor", at.alias("_a")).join(best, "_a", "left").withColumn("matched", F.coalesce(F.col("m.metres") <= dist_tol, F.lit(False)))
    return out.select("anchor", F.when(F.col("matched"), F.col("m.stop_id")).alias("stop_id"), F.col("m.metres").alias("distance_m"), "matched")
