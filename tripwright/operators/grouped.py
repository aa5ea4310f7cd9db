"""Whole groups to a vectorised kernel, without one Python call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group begins; equal keys are adjacent, nulls equal nulls."""
    n = table.num_rows
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        idx = np.asarray(codes.indices)
        new[1:] |= idx[1:] != idx[:-1]
    return np.flatnonzero(new)


def map_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    kernel: Callable[[pa.Table, np.ndarray], pa.Table | pa.RecordBatch],
    schema: str,
    min_rows: int = 20_000,
) -> DataFrame:
    """Rows of ``df`` hash-partitioned by ``keys``, sorted by ``keys`` then ``order``, to ``kernel`` in whole groups.

    ``kernel(table, starts)`` gets a table of complete groups (many small ones at a time, or one large one)
    with the row number at which each begins, and returns a table of ``schema``. A task holds
    no more than the largest group and one batch. One exchange; an empty input calls no kernel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        due = min_rows

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            made = kernel(table, group_starts(table, keys))
            yield from made.to_batches() if isinstance(made, pa.Table) else [made]

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < due:
                continue
            table = pa.Table.from_batches(held)
            starts = group_starts(table, keys)
            cut = int(starts[-1])
            if cut == 0:  # one group so far: look again when it has doubled
                due = 2 * rows
                continue
            yield from out(table.slice(0, cut))
            rest = table.slice(cut)
            held, rows = rest.combine_chunks().to_batches(), rest.num_rows
            due = max(min_rows, 2 * rows)
        if rows:
            yield from out(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def map_streams(df: DataFrame, keys: list[str], order: list[str], step: Callable[[pa.Table, np.ndarray, object], tuple[pa.Table, object]], schema: str) -> DataFrame:
    """Rows of ``df`` hash-partitioned by ``keys``, sorted by ``keys`` then ``order``, to ``step`` batch by batch.

    ``step(table, starts, state)`` gets the rows of one batch, the row numbers at which groups begin (without 0 if the first
    rows go on with the group of the batch before) and what it returned as state then (None at first); it returns a table of
    ``schema`` and the state of its last group. A task holds one batch, however large a group is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        state: object = None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            starts = group_starts(table, keys)
            first = [table.column(k)[0].as_py() for k in keys]
            made, state = step(table, starts[1:] if first == last else starts, state)
            last = [table.column(k)[b.num_rows - 1].as_py() for k in keys]
            yield from made.combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
