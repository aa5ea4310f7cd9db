"""Queries of the operators for training text over the documents of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import pings as P
from . import look_sql
from .encoding import encoded
from .lookalike import alike_classes, alike_pairs, learn, unified
from .mixing import Mixture, mix
from .runs import runs
from ..plans.data_sql import RUNS
from ..shared import stage
from ..sources.tables import table

TOKENIZER = "byte_bpe_50k"


def _runs(spark: SparkSession, d: str, **how: object) -> DataFrame:
    rows = P.kept(P.arrivals(table(spark, d, "gps_data"), table(spark, d, "feeds"), "direction"))
    return runs(rows, "vehicle_id", "t", "span", "direction", **how)


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of like direction with duration and number of pings."""
    return _runs(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two or more pings."""
    return p4_runs(spark, d).where("n_events >= 2").select("vehicle_id", "start_us", "end_us")


def p4_near(spark: SparkSession, d: str) -> DataFrame:
    """Runs of nearly the same direction, joined over silences of at most ten minutes."""
    return _runs(spark, d, similarity=0.6, max_gap_us=600_000_000)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encoded(table(spark, d, "documents"), "doc_id", "text", TOKENIZER)


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), TOKENIZER)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every slot of the mixture with its block of tokens."""
    return _mixture(spark, d).rows()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mixture(spark, d).shares


def _forms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return unified(docs, "doc_id", "text", learn(docs, "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same and are written differently."""
    return alike_pairs(stage(_forms(spark, d).select("doc_id", "look", "raw"), "looks"), "doc_id")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that look like others written differently, by class."""
    return alike_classes(stage(_forms(spark, d).select("doc_id", "look", "raw"), "looks"), "doc_id")


def p10_unified(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every document's text."""
    return _forms(spark, d).select("doc_id", "unified")


QUERIES = {f.__name__: f for f in (p4_found, p4_runs, p4_near, p8_ids, p9_mixture, p9_shares, p10_found, p10_classes, p10_unified)}
ORACLE = {"p4_runs": RUNS, "p4_found": f"SELECT vehicle_id, start_us, end_us FROM ({RUNS}) WHERE n_events >= 2"} | look_sql.ORACLE
