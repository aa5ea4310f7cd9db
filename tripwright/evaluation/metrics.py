"""Scores of a segmentation against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stage
from .matching import GROUP, match_segments


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r))


def _weights(df: DataFrame, weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else (F.col("end_us") - F.col("start_us")) / 1e6


def flagged(pred: DataFrame, truth: DataFrame, matches: DataFrame, iou_threshold: float, weight: str | None) -> DataFrame:
    """Segments of both kinds (kind, seg_id, vehicle_id, route_id, w, n_pings, hit): hit if matched at the threshold."""
    hits = matches.where(F.col("iou") >= iou_threshold)
    pings = F.col("n_pings").cast("bigint") if "n_pings" in pred.columns else F.lit(None).cast("bigint")
    p = pred.select(F.lit("pred").alias("kind"), "seg_id", *GROUP, _weights(pred, weight).alias("w"), pings.alias("n_pings"))
    t = truth.select(F.lit("truth").alias("kind"), "seg_id", *GROUP, _weights(truth, weight).alias("w"), F.lit(None).cast("bigint").alias("n_pings"))
    hp = hits.select(F.col("pred_id").alias("seg_id"), F.lit(True).alias("hit"))
    ht = hits.select(F.col("truth_id").alias("seg_id"), F.lit(True).alias("hit"))
    out = p.join(hp, "seg_id", "left").unionByName(t.join(ht, "seg_id", "left"))
    return out.withColumn("hit", F.coalesce("hit", F.lit(False)))


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    p, t = F.col("kind") == "pred", F.col("kind") == "truth"
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count_if(p & F.col("hit")).alias("tp"), F.count_if(p).alias("n_p"), F.count_if(t).alias("n_t"),
        total(p & F.col("hit")).alias("wp_hit"), total(p).alias("wp"), total(t & F.col("hit")).alias("wt_hit"), total(t).alias("wt"),
        F.sum(F.when(p & F.col("hit"), F.col("n_pings"))).alias("pings_hit"), F.sum(F.when(p, F.col("n_pings"))).alias("pings"),
    )


_SUMS = ("tp", "n_p", "n_t", "wp_hit", "wp", "wt_hit", "wt", "pings_hit", "pings")


def _up(sums: DataFrame, *keys: str) -> DataFrame:
    """Sums of clusters brought up to fewer keys."""
    out = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS])
    return out if keys else out.select(*[F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType)).alias(c) if not c.startswith("pings") else F.col(c) for c in _SUMS])


def macro_metrics(rows: DataFrame) -> DataFrame:
    """One row of precision, recall and F1 averaged over the routes of either table; F1 is 2tp / (2tp + fp + fn)."""
    return _macro(_sums(rows, "route_id"))


def _macro(r: DataFrame) -> DataFrame:
    per = r.select(_ratio(F.col("tp"), F.col("n_p")).alias("p"), _ratio(F.col("tp"), F.col("n_t")).alias("r"), _ratio(2 * F.col("tp"), F.col("n_p") + F.col("n_t")).alias("f"))
    return per.agg(F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"))


#: Parts into which the units of the bootstrap are hashed, so that numbering them is no single task.
UNIT_PARTS = 256


def bootstrap(sums: DataFrame, unit: str, n_boot: int, seed: int) -> DataFrame:
    """One row (f1_low, f1_high): 2.5 and 97.5 % points of the weighted F1 over resamples of whole routes or vehicles.

    sums: a row of sums a cluster, of which matching falls apart by. Draw i of replicate b is a hash of both; units are
    numbered within parts, behind the number of units in the parts before. Nothing is null unless there is
    one cluster or none.
    """
    c = _up(sums, unit).withColumn("part", F.pmod(F.xxhash64(unit), F.lit(UNIT_PARTS)))
    own = F.row_number().over(Window.partitionBy("part").orderBy(unit)) - 1
    sizes = c.groupBy("part").agg(F.count("*").alias("n"))
    # at most UNIT_PARTS rows
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("k"))
    c = stage(c.withColumn("own", own).join(F.broadcast(base), "part").withColumn("no", F.col("base") + F.col("own")), "units")
    draws = c.select("no", "k").where("k > 1").select(F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"), F.col("no").alias("i"), "k")
    draws = draws.select("b", F.pmod(F.xxhash64("b", "i", F.lit(seed)), F.col("k")).alias("no")).groupBy("b", "no").agg(F.count("*").alias("m"))
    s = draws.join(c, "no").groupBy("b").agg(*[F.sum(F.col(x) * F.col("m")).alias(x) for x in ("wp_hit", "wp", "wt_hit", "wt")])
    f = s.select(_f1(_ratio(F.col("wp_hit"), F.col("wp")), _ratio(F.col("wt_hit"), F.col("wt"))).alias("f"))
    return f.agg(F.percentile("f", F.lit(0.025)).alias("f1_low"), F.percentile("f", F.lit(0.975)).alias("f1_high"))


def segment_metrics(
    pred: DataFrame, truth: DataFrame, iou_threshold: float = 0.5, weight: str | None = None, gap_us: int = 14_400_000_000, n_boot: int = 200, seed: int = 1, boot_unit: str = "route_id"
) -> DataFrame:
    """One row of scores: counts, unweighted and weighted precision, recall and F1, macro means, split and merge rates,
    coverage of service time and pings, boundary errors of hits, and the bootstrap interval of the weighted F1.

    What has no denominator is null. ``weight``: a column of both tables (else the duration in seconds).
    """
    if boot_unit not in GROUP:
        raise ValueError("boot_unit must be route_id or vehicle_id")
    mm = match_segments(pred, truth, gap_us)
    rows = flagged(pred, truth, mm.matches, iou_threshold, weight)
    tp, n_p, n_t = F.col("tp"), F.col("n_p"), F.col("n_t")
    sums = stage(_sums(rows, *GROUP), "sums")  # one row a vehicle and route: all totals come from it
    s = _up(sums).join(mm.counts, how="inner").join(_macro(_up(sums, "route_id")), how="inner").join(bootstrap(sums, boot_unit, n_boot, seed), how="inner")
    hits = mm.matches.where(F.col("iou") >= iou_threshold)
    errors = hits.agg(*[f(c).alias(f"{c}_{n}") for c in ("boundary_start_err", "boundary_end_err") for n, f in (("min", F.min), ("median", F.median), ("mean", F.avg), ("max", F.max))])
    p, r, wp, wr = _ratio(tp, n_p), _ratio(tp, n_t), _ratio(F.col("wp_hit"), F.col("wp")), _ratio(F.col("wt_hit"), F.col("wt"))
    return s.join(errors, how="inner").select(
        tp.alias("tp"), (n_p - tp).alias("fp"), (n_t - tp).alias("fn"), p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"),
        wp.alias("weighted_precision"), wr.alias("weighted_recall"), _f1(wp, wr).alias("weighted_f1"), "macro_precision", "macro_recall", "macro_f1",
        "splits", "merges", _ratio(F.col("splits"), n_t).alias("fragment_rate"), _ratio(F.col("merges"), n_p).alias("merge_rate"),
        wr.alias("duration_coverage"), (F.col("wt") - F.col("wt_hit")).alias("unassigned_duration"), _ratio(F.coalesce("pings_hit", F.lit(0)), F.col("pings")).alias("ping_coverage"),
        *errors.columns, "f1_low", "f1_high",
    )


def pattern_ari(labels: DataFrame, pred: str, true: str) -> DataFrame:
    """One row (ari): adjusted Rand index of two labellings; null under two rows, 1 where it is degenerate.

    Rows with a null label count for nothing.
    """
    ok = labels.where(F.col(pred).isNotNull() & F.col(true).isNotNull())
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    cells = ok.groupBy(pred, true).agg(F.count("*").alias("n"))
    ij = cells.agg(F.coalesce(F.sum(two("n")), F.lit(0.0)).alias("ij"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    a = cells.groupBy(pred).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(two("n")), F.lit(0.0)).alias("a"))
    b = cells.groupBy(true).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(two("n")), F.lit(0.0)).alias("b"))
    t = ij.join(a, how="inner").join(b, how="inner")
    t = t.withColumn("expected", F.when(F.col("n") > 1, F.col("a") * F.col("b") / two("n"))).withColumn("most", (F.col("a") + F.col("b")) / 2.0)
    ari = F.when(F.col("n") < 2, F.lit(None)).when(F.col("most") == F.col("expected"), 1.0).otherwise((F.col("ij") - F.col("expected")) / (F.col("most") - F.col("expected")))
    return t.select(ari.cast("double").alias("ari"))
