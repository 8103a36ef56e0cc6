"""Arrow columns as NumPy blocks, and sums of NumPy arrays over a distributed table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

FAN_IN = 64  # partial results the driver adds up itself


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """list<double> column as a 2-D array."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(array) == 0:
        return np.empty((0, 0))
    widths = array.value_lengths().to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(~(widths == widths[0]))  # a null row has no width and equals nothing
    if array.null_count or len(odd):
        raise ValueError(f"row {0 if array.null_count and not len(odd) else odd[0]} of the batch has a missing vector or one of another width")
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def rows_of(block: np.ndarray) -> pa.Array:
    """2-D array as a list<double> column."""
    ends = np.arange(len(block) + 1, dtype="int32") * block.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(block, dtype=float).ravel()))


def _one_row(slot: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), rows_of(total[None, :])], names=["slot", "total"])


def partition_totals(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """One vector per partition, brought to the driver in partition order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _one_row(TaskContext.get().partitionId(), work(batches))

    rows = df.mapInArrow(run, "slot int, total array<double>").toArrow()
    totals = matrix(rows["total"])
    slots = rows["slot"].to_numpy()
    return [(int(slots[i]), totals[i]) for i in np.argsort(slots, kind="stable")]


def summed(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray], partitions: int | None = None) -> np.ndarray:
    """Sum over partitions of the vector ``work`` returns for each of them.

    Unless there are known to be few partitions, executors add the vectors up in groups
    first, so the driver receives few rows at any scale.
    """
    if partitions is not None and partitions <= FAN_IN:
        return np.sum([t for _, t in partition_totals(df, work)], axis=0)
    groups = math.isqrt(partitions) if partitions else FAN_IN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _one_row(TaskContext.get().partitionId() % groups, work(batches))

    def add(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_one_row(table["slot"][0].as_py(), matrix(table["total"]).sum(0))])

    schema = "slot int, total array<double>"
    rows = df.mapInArrow(run, schema).groupBy("slot").applyInArrow(add, schema).toArrow()
    return matrix(rows["total"])[np.argsort(rows["slot"].to_numpy())].sum(0)


def summed_apart(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray], pieces: int = FAN_IN) -> np.ndarray:
    """The same sum of long vectors: each piece of them is added up by one executor task, so the driver receives one vector alone.

    Partitions are added in their order, so reruns agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = TaskContext.get().partitionId()
        for slot, piece in enumerate(np.array_split(work(batches), pieces)):
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([source], pa.int32()), rows_of(piece[None, :])], names=["slot", "source", "total"])

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table["source"].to_numpy())
        return pa.Table.from_batches([_one_row(table["slot"][0].as_py(), matrix(table["total"])[order].sum(0))])

    rows = df.mapInArrow(run, "slot int, source int, total array<double>").groupBy("slot").applyInArrow(add, "slot int, total array<double>").toArrow()
    totals = {slot: np.array(total) for slot, total in zip(rows["slot"].to_pylist(), rows["total"].to_pylist())}
    return np.concatenate([totals[slot] for slot in range(pieces)])


def block_columns(batch: pa.RecordBatch) -> dict[str, Any]:
    return {
        name: matrix(batch[name]) if pa.types.is_list(batch.schema.field(name).type) else batch[name].to_numpy(zero_copy_only=False)
        for name in batch.schema.names
    }
