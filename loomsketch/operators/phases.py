"""Phase histograms: how a sequence's subsequences of a length fall into phases, the sums of their codes' phases modulo a number.

A histogram is a tensor sketch without signs, as shares; a sequence has one for each of several tables, its channels. From it come
the contrast of even and odd phases, with bins of equal mass under a Cauchy distribution, and whole histograms. Windows take them from the
sliding state. A window's histogram can be the symbol of the next level, whose sequences are soft: each position has a weight for every code.

Sequences and windows of fewer codes than the tuple have histograms of zeros, and a contrast of 0. Null sequences have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maths
from ..functions.alphabet import valid_codes
from ..functions.hashing import TensorTables
from . import tensors
from .sliding import chunk_codes, count_of_ends, slide_sums


def phase_tables(size: int, t: int, phases: int, channels: int, seed: int = 42) -> list[TensorTables]:
    """Tables without signs, one for each channel."""
    drawn = [TensorTables.drawn(size, t, phases, seed + i) for i in range(channels)]
    return [TensorTables(d.hashes, tuple((1,) * size for _ in range(t)), phases) for d in drawn]


def histograms(seq: Column, tables: list[TensorTables]) -> Column:
    """Of each channel the histogram of a whole sequence: array<array<double>>, by built-in functions."""
    return F.array(*(tensors.tensor_sketch(seq, t) for t in tables))


def contrast(histogram: Column) -> Column:
    """The shares of even phases less those of odd ones."""
    signed = F.transform(histogram, lambda x, p: F.when(p % 2 == 0, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0.0), lambda s, x: s + x)


def binned(value: Column, bins: int) -> Column:
    """A contrast's bin from 1 to bins; without bins, the contrast."""
    if not bins:
        return value
    edges = F.array(*(F.lit(e) for e in maths.bin_edges(bins)[: bins - 1]))
    return 1 + F.size(F.filter(edges, lambda e: e <= value))


def contrasts(seq: Column, tables: list[TensorTables], bins: int = 0) -> Column:
    """A sequence's sketch of a contrast, or its bin, for each channel."""
    return F.transform(histograms(seq, tables), lambda h: binned(contrast(h), bins))


def _shares(sums: np.ndarray) -> np.ndarray:
    total = np.abs(sums).sum(1, keepdims=True)
    return np.divide(sums, total, out=np.zeros(sums.shape), where=total > 0)


def _rows(ids: pa.Array, which: np.ndarray, channel: np.ndarray, index: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel()))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(which)), pa.array(channel.astype(np.int32)), pa.array(index.astype(np.int32)), lists], names=["seq_id", "channel", "win_idx", "histogram"])


def _schema(df: DataFrame) -> str:
    return f"seq_id {df.schema['seq_id'].dataType.simpleString()}, channel int, win_idx int, histogram array<double>"


def sliding_histograms(df: DataFrame, tables: list[TensorTables], window: int, stride: int, offset: int = 0, last: bool = True) -> DataFrame:
    """(seq_id, channel, win_idx, histogram) of df(seq_id, seq): windows of so many codes, or all there are, that end at each position which is offset
    modulo stride, and with last at the sequence's last position too. Sequences are cut into chunks, so that one is many tasks' work."""
    if min(window, stride) < 1:
        raise ValueError("window and stride must be positive")
    size, step = tables[0].size, chunk_codes(window, stride)
    firsts = F.when(F.size("codes") > 0, F.sequence(F.lit(0), F.size("codes") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = df.select("seq_id", valid_codes(F.col("seq"), size).alias("codes")).select("seq_id", "codes", F.explode(firsts).alias("first"))
    lead = F.least("first", F.lit(window))
    final = (F.col("first") + step >= F.size("codes")) & F.lit(last)
    chunks = rows.select("seq_id", "first", lead.alias("lead"), final.alias("final"), F.slice("codes", F.col("first") - lead + 1, lead + step).alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, leads, final = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            codes = [np.asarray(x, np.int64) for x in batch.column(4).to_numpy(zero_copy_only=False)]
            before = np.array([count_of_ends(int(f), stride, offset) for f in firsts], np.int64)
            for channel, table in enumerate(tables):
                made = slide_sums(codes, leads, table, window, stride, offset, final)
                counts = np.array([len(m) for m in made], np.int64)
                if counts.sum():
                    index = np.concatenate([b + np.arange(n) for b, n in zip(before, counts, strict=True)])
                    yield _rows(batch.column(0), np.repeat(np.arange(len(counts)), counts), np.full(counts.sum(), channel), index, _shares(np.concatenate(made)))

    return chunks.mapInArrow(run, _schema(df))


def soft_histograms(df: DataFrame, tables: list[list[TensorTables]], window: int, stride: int, last: bool = True) -> DataFrame:
    """(seq_id, channel, win_idx, histogram) of df(seq_id, channel, soft): a sequence of histograms (array<array<double>>) for each channel c below the number
    of lists of tables, sketched by tables[c]. Channels of the result follow one another: those of channel 0 first. A row holds a
    whole soft sequence, which is a window's stride shorter than the codes it is from. Null weights count as 0."""
    if min(window, stride) < 1:
        raise ValueError("window and stride must be positive")
    starts = np.cumsum([0, *(len(t) for t in tables)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            channels = batch.column(1).to_numpy(zero_copy_only=False)
            soft = batch.column(2).to_pylist()
            for c in sorted({int(x) for x in channels if 0 <= x < len(tables)}):
                mine = np.flatnonzero(channels == c)
                size = tables[c][0].size
                given = [np.array([[w or 0.0 for w in (step or ())[:size]] + [0.0] * (size - len(step or ())) for step in soft[i] or ()], float).reshape(-1, size) for i in mine]
                none = np.zeros(len(mine), np.int64)
                for e, table in enumerate(tables[c]):
                    made = slide_sums(given, none, table, window, stride, 0, np.full(len(mine), last))
                    counts = np.array([len(m) for m in made], np.int64)
                    if counts.sum():
                        index = np.concatenate([np.arange(n) for n in counts])
                        yield _rows(batch.column(0), mine[np.repeat(np.arange(len(counts)), counts)], np.full(counts.sum(), starts[c] + e), index, _shares(np.concatenate(made)))

    return df.where("seq_id IS NOT NULL AND channel IS NOT NULL").select("seq_id", "channel", "soft").mapInArrow(run, _schema(df))


def as_soft(histogram_rows: DataFrame) -> DataFrame:
    """(seq_id, channel, soft): the windows' histograms of each channel in order, as the next level takes them."""
    ordered = F.array_sort(F.collect_list(F.struct("win_idx", "histogram")))
    return histogram_rows.groupBy("seq_id", "channel").agg(F.transform(ordered, lambda x: x.histogram).alias("soft"))


def squeezed(histogram_rows: DataFrame) -> DataFrame:
    """(seq_id, sketch): all numbers of a sequence in one array, by channel, window and phase."""
    ordered = F.array_sort(F.collect_list(F.struct("channel", "win_idx", "histogram")))
    return histogram_rows.groupBy("seq_id").agg(F.flatten(F.transform(ordered, lambda x: x.histogram)).alias("sketch"))
