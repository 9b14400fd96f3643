"""Tensor sketches of sequences that lie in many rows: each part has a state, and states of neighbours merge in a tree.

A state is the part's number of codes and, for every run of tuple places p..q, the mean over its subsequences of that length. Of a
concatenation, a subsequence has its first l places in the left part and the others in the right; so the mean is that of the
circular convolutions of both parts' means, weighed by how many subsequences have l places on the left: a merge that is associative and
keeps the order. Codes outside the alphabet are left out; sequences shorter than the tuple have sketches of zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import TensorTables
from .sliding import TOGETHER, Window, kind_of, runs_of

#: States that one task merges at a level of the tree.
FAN = 16


def wrapped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The circular convolution of two vectors of one length."""
    full = np.convolve(a, b)
    out = full[: len(a)].copy()
    out[: len(a) - 1] += full[len(a) :]
    return out


def states(parts: list[np.ndarray], tables: TensorTables) -> list[tuple[int, np.ndarray]]:
    """(n, means by run) of each part's codes, which are within the alphabet."""
    out: list = [None] * len(parts)
    order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
    for at in range(0, len(order), TOGETHER):
        some = order[at : at + TOGETHER]
        longest = len(parts[some[-1]])
        grid = np.full((len(some), longest), tables.size, np.int64)
        for row, i in enumerate(some):
            grid[row, : len(parts[i])] = parts[i]
        window = Window(len(some), tables, kind_of(longest, tables.t))
        for i in range(longest):
            window.add(grid[:, i])
        for row, i in enumerate(some):
            n = len(parts[i])
            out[i] = (n, np.stack([window.sums[p, q][row] / max(1, comb(n, q - p + 1)) for p, q in runs_of(tables.t)]))
    return out


def joined(left: tuple[int, np.ndarray], right: tuple[int, np.ndarray], t: int) -> tuple[int, np.ndarray]:
    """The state of left and right in a row."""
    (n, a), (m, b) = left, right
    runs = runs_of(t)
    place = {run: i for i, run in enumerate(runs)}
    out = np.zeros_like(a)
    for i, (p, q) in enumerate(runs):
        size = q - p + 1
        whole = comb(n + m, size)
        for on_left in range(size + 1):
            share = comb(n, on_left) * comb(m, size - on_left) / whole if whole else 0.0
            if not share:
                continue
            if on_left == 0:
                out[i] += share * b[i]
            elif on_left == size:
                out[i] += share * a[i]
            else:
                out[i] += share * wrapped(a[place[p, p + on_left - 1]], b[place[p + on_left, q]])
    return n + m, out


def merged_sketches(parts: DataFrame, tables: TensorTables, fan: int = FAN) -> DataFrame:
    """(seq_id, n, sketch) of parts(seq_id, part, seq), whose part numbers, one a row, are in the order of the sequence; they may
    have gaps. n counts codes within the alphabet. Rows without a part number, a sequence or its id are left out."""
    given = parts.where(F.col("seq_id").isNotNull() & F.col("part").isNotNull() & F.col("seq").isNotNull())
    low, high = given.agg(F.min("part"), F.max("part")).first()
    kind = parts.schema["seq_id"].dataType.simpleString()
    schema = f"seq_id {kind}, part long, n long, state array<double>"
    runs, dim = len(runs_of(tables.t)), tables.dim

    def batch_of(ids: pa.Array, numbers, made: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        lists = pa.array([s.ravel().tolist() for _, s in made], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([ids, pa.array(numbers, pa.int64()), pa.array([n for n, _ in made], pa.int64()), lists], names=["seq_id", "part", "n", "state"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.asarray(c, np.int64) for c in batch.column(2).to_numpy(zero_copy_only=False)]
            yield batch_of(batch.column(0), batch.column(1), states([c[(c >= 0) & (c < tables.size)] for c in codes], tables))

    def level(group: pa.Table) -> pa.Table:
        rows = sorted(range(group.num_rows), key=group.column("part").to_pylist().__getitem__)
        n, state = group.column("n").to_pylist(), group.column("state").to_pylist()
        made = [(n[r], np.array(state[r]).reshape(runs, dim)) for r in rows]
        whole = made[0]
        for more in made[1:]:
            whole = joined(whole, more, tables.t)
        return pa.Table.from_batches([batch_of(group.column("seq_id").combine_chunks().slice(0, 1), [group.column("part")[rows[0]].as_py() // fan], [whole])])

    known = F.filter("seq", lambda c: c.isNotNull())
    now = given.select("seq_id", (F.col("part") - F.lit(low if low is not None else 0)).cast("long").alias("part"), known.alias("seq")).mapInArrow(first, schema)
    most = (high - low) if low is not None else 0
    while True:
        now = now.groupBy("seq_id", F.floor(F.col("part") / fan).alias("to")).applyInArrow(level, schema)
        most //= fan
        if not most:
            break
    return now.select("seq_id", "n", F.slice("state", F.lit((tables.t - 1) * dim + 1), F.lit(dim)).alias("sketch"))
