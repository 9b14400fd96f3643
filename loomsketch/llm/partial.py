"""Sums of arrays over all rows of a table: each partition sends one, and a tree of tasks adds them up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays that one task adds up.
FAN = 64


def totals(df: DataFrame, summed: Callable[[Iterator[pa.RecordBatch]], np.ndarray], merge: Callable[[list[np.ndarray]], np.ndarray] | None = None) -> np.ndarray | None:
    """What merge (a sum, if not given) makes of the arrays, of one type and shape each, that summed makes of df's
    partitions; None if df has no partitions. Two levels of tasks merge FAN arrays each, so that the driver gets one for
    some 4,000 partitions. The order is that of the partitions, so reruns agree to the last bit."""
    merge = merge or (lambda some: np.sum(some, axis=0))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.ascontiguousarray(summed(batches))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "type": [made.dtype.str], "shape": pa.array([list(made.shape)], pa.list_(pa.int64())), "bytes": [made.tobytes()]})

    def read(table: pa.Table) -> list[tuple[int, np.ndarray]]:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        return [(r["part"], np.frombuffer(r["bytes"], np.dtype(r["type"])).reshape(r["shape"])) for r in rows]

    def next_level(group: pa.Table) -> pa.Table:
        rows = read(group)
        made = np.ascontiguousarray(merge([a for _, a in rows]))
        return pa.table({"part": pa.array([rows[0][0] // FAN], pa.int64()), "type": [made.dtype.str], "shape": pa.array([list(made.shape)], pa.list_(pa.int64())), "bytes": pa.array([made.tobytes()], pa.binary())})

    schema = "part long, type string, shape array<long>, bytes binary"
    level = df.mapInArrow(first, schema)
    for _ in range(2):
        level = level.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInArrow(next_level, schema)
    rows = read(level.toArrow())
    return merge([a for _, a in rows]) if rows else None
