"""Documents as files of Simple-8b segments, in ascending doc_id order, and back.

A file's rows are segments: (part, segment, ids, data). Parts ascend with doc_id (null first; rows of one doc_id lie
side by side in no fixed order), and segments within a part; data is a segment in simple8b's format.
The container is Parquet, so any store that Spark writes to will do. Null and empty texts are documents with
the end id alone; no documents give no segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .simple8b import read_segment, write_segment
from .tokenise import encoder

#: Ids that fill a segment; a longer document has one to itself.
SEGMENT = 1 << 20
SEGMENTS = "part int, segment int, ids long, data binary"


def write(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """The files of docs(doc_id, text) in the shared folder, as rows (part, segment, ids, data)."""
    end = np.array([end_id], "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        found: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, found, size, segment
            data = write_segment(names, [len(x) for x in found], np.concatenate(found))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "ids": pa.array([size], pa.int64()), "data": pa.array([data], pa.binary())})
            names, found, size, segment = [], [], 0, segment + 1
            return row

        encode_texts = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                for doc, ids in zip(some.column(0).to_pylist(), encode_texts([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    names.append(doc)
                    found.append(np.append(ids, end))
                    size += len(ids) + 1
                    if size >= SEGMENT:
                        yield flush()
        if names:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(encode, SEGMENTS), "token-ids", codec="uncompressed")


def read(files: DataFrame, value: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, start) of write()'s files: start counts the ids before the document, ids are little-endian
    u32. value: an expression of ids to return in their stead."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                names, lengths, ids = read_segment(data)
                ids = ids.astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                for at in range(0, len(names), 256):
                    some = range(at, min(at + 256, len(names)))
                    begin, end = int(ends[at] - lengths[at]), int(ends[some[-1]])
                    bounds = np.append(ends[at : at + 256] - lengths[at : at + 256] - begin, end - begin)
                    own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(4 * bounds.astype(np.int64)), pa.py_buffer(ids[begin:end])])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array([part] * len(some), pa.int32()),
                            "segment": pa.array([segment] * len(some), pa.int32()),
                            "doc_id": pa.array([names[i] for i in some], pa.int64()),
                            "inside": pa.array(ends[at : at + 256] - lengths[at : at + 256], pa.int64()),
                            "n_tokens": pa.array(lengths[at : at + 256].astype(np.int64)),
                            "ids": own.cast(pa.binary()),
                        }
                    )

    rows = files.select("part", "segment", "data").mapInArrow(decode, "part int, segment int, doc_id long, inside long, n_tokens long, ids binary")
    rows = rows.select("part", "segment", "doc_id", "inside", "n_tokens", F.col("ids") if value is None else value)
    parts = files.groupBy("part").agg(F.sum("ids").alias("all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("of_part"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    of_segment = F.coalesce(F.sum("ids").over(within), F.lit(0))
    firsts = files.select("part", "segment", of_segment.alias("of_segment")).join(parts, "part")
    firsts = firsts.select("part", "segment", (F.col("of_part") + F.col("of_segment")).alias("first"))
    return rows.join(firsts, ["part", "segment"]).withColumn("start", F.col("first") + F.col("inside")).drop("part", "segment", "first", "inside")
