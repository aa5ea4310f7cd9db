"""Scores of trip orientation: coverage and accuracy, risk against coverage, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import part_sums, ranged


def _clean(matched: DataFrame, end_to_end: bool) -> DataFrame:
    if "clean" not in matched.columns:
        if end_to_end:
            raise ValueError("without a column clean merged trips can't be left out; pass end_to_end=False to score what there is")
        return matched
    return matched.where("clean")


def mapped(matched: DataFrame, end_to_end: bool = True) -> DataFrame:
    """Clean matches with an orientation, and pred_mapped: per route as it is or swapped, whichever agrees more (as it is if equal).

    matched: route_id, pred_orientation (0, 1 or null), truth_direction (0, 1), clean, pred_confidence if known.
    """
    c = _clean(matched, end_to_end).where("pred_orientation is not null")
    per = c.groupBy("route_id").agg(F.avg((F.col("pred_orientation") == F.col("truth_direction")).cast("double")).alias("i"), F.avg((F.col("pred_orientation") == 1 - F.col("truth_direction")).cast("double")).alias("s"))
    swap = F.coalesce(F.col("i") < F.col("s"), F.lit(False))
    return c.join(per.select("route_id", swap.alias("_swap")), "route_id").withColumn("pred_mapped", F.when(F.col("_swap"), 1 - F.col("pred_orientation")).otherwise(F.col("pred_orientation"))).drop("_swap")


def orientation_scores(matched: DataFrame, n_truth_total: int, min_coverage: float = 0.7, end_to_end: bool = True) -> DataFrame:
    """One row: coverage over clean matches, recalls and abstention by class, accuracies, recovery over all true trips.

    Without a column clean only end_to_end=False is allowed, and recovery is null. Empty denominators give null.
    """
    clean, m = _clean(matched, end_to_end), mapped(matched, end_to_end)
    right = (F.col("pred_mapped") == F.col("truth_direction")).cast("double")
    by_class = lambda e, k: F.avg(F.when(F.col("truth_direction") == k, e))
    silent = F.col("pred_orientation").isNull().cast("double")
    a = clean.agg(F.count("*").alias("n_clean"), by_class(silent, 0).alias("abstention0"), by_class(silent, 1).alias("abstention1"))
    b = m.agg(F.count("*").alias("n_covered"), by_class(right, 0).alias("recall0"), by_class(right, 1).alias("recall1"), F.avg(right).alias("conditional_accuracy"), F.coalesce(F.sum(right), F.lit(0.0)).alias("recovered"))
    one = clean.where("truth_direction is not null").groupBy("route_id").agg(F.count_distinct("truth_direction").alias("k")).agg(F.count_if(F.col("k") < 2).alias("single_class_routes"))
    t = a.join(b, how="inner").join(one, how="inner").join(matched.agg(F.count("*").alias("n_matched")), how="inner")
    coverage = F.when(F.col("n_clean") > 0, F.col("n_covered") / F.col("n_clean"))
    known = F.when(F.col("recall0").isNotNull(), 1).otherwise(0) + F.when(F.col("recall1").isNotNull(), 1).otherwise(0)
    balanced = F.when(known > 0, (F.coalesce("recall0", F.lit(0.0)) + F.coalesce("recall1", F.lit(0.0))) / known)
    recovery = F.col("recovered") / F.lit(n_truth_total) if end_to_end and n_truth_total else F.lit(None).cast("double")
    return t.select(
        coverage.alias("coverage"), F.coalesce(coverage >= min_coverage, F.lit(False)).alias("min_coverage_gate"), balanced.alias("balanced_accuracy"),
        "recall0", "recall1", "abstention0", "abstention1", "single_class_routes", "conditional_accuracy", recovery.alias("end_to_end_recovery"), "n_matched", "n_clean",
    )


def risk_coverage(matched: DataFrame, tie: str, end_to_end: bool = True) -> DataFrame:
    """(rank, coverage, selective_error) with falling confidence; unknown confidence last, ties by ``tie``.

    Rows are ranged by confidence and tie, ranks run within parts behind those of the parts before: however many rows
    share a confidence, or have none, no task holds the whole.
    """
    n = _clean(matched, end_to_end).agg(F.count("*").alias("n_clean"))
    m = mapped(matched, end_to_end).withColumn("wrong", (F.col("pred_mapped") != F.col("truth_direction")).cast("bigint"))
    order = (F.desc_nulls_last("pred_confidence"), F.col(tie))
    parts = ranged(m.select("pred_confidence", tie, "wrong"), *order)
    base = part_sums(parts, n0=F.count("*"), w0=F.coalesce(F.sum("wrong"), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy(*order)
    # as many rows as parts
    m = parts.withColumns({"k": F.row_number().over(inside), "e": F.sum("wrong").over(inside.rowsBetween(Window.unboundedPreceding, 0))}).join(F.broadcast(base), "_part")
    rank = F.col("n0") + F.col("k")
    return m.join(n, how="inner").select(rank.alias("rank"), (rank / F.col("n_clean")).alias("coverage"), ((F.col("w0") + F.col("e")) / rank).alias("selective_error"))


def calibration(matched: DataFrame, end_to_end: bool = True) -> DataFrame:
    """(bin, n, mean_conf, acc, ece): ten bins of confidence, closed above, the first also below; ece over all bins."""
    m = mapped(matched, end_to_end).where("pred_confidence is not null")
    # the edges are tenths as decimals, so that 0.3 lies in the third bin
    b = F.greatest(F.ceil(F.round(F.col("pred_confidence") * 10, 9)), F.lit(1)).cast("int")
    t = m.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("pred_confidence").alias("mean_conf"), F.avg((F.col("pred_mapped") == F.col("truth_direction")).cast("double")).alias("acc"))
    every = Window.partitionBy(F.lit(1))  # ten rows
    return t.withColumn("ece", F.sum(F.col("n") * F.abs(F.col("acc") - F.col("mean_conf"))).over(every) / F.sum("n").over(every))
