"""Exactly-once delivery of a stream of at-least-once messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.seen import SeenStore


def first_deliveries(stream: DataFrame, store_folder: str, key: str, at: str, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands each micro-batch's first deliveries to ``sink`` (rows, batch number); start it with a checkpoint.

    stream: id (unique), ``key`` and ``at`` (micros) and anything beside them. What was seen in earlier batches is kept out
    however long ago it came, unlike under a watermark. A batch replayed after a failure yields the same rows
    again, so a sink that overwrites by batch number holds each message once. Batches are known by the id of their query, which
    lives in its checkpoint, and their number: several queries may fill one store, one after another.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        store = SeenStore(batch.sparkSession, store_folder)
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        kept = store.absorb(rows.select("id", F.col(key).alias("k"), F.col(at).alias("at")), f"{query}/{number}")
        sink(rows.join(kept, "id", "left_semi"), number)
        rows.unpersist()

    return stream.writeStream.foreachBatch(each)
