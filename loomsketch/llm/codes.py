"""Vectors compressed to codes by product quantisation, with exact integer codebooks and bounds that save rescans.

Components become integers, floor(256 x), and vectors are cut into PARTS consecutive parts. Each part position has a codebook
of up to ENTRIES entries, first those of the vectors of smallest vec_id; a round assigns every part to its nearest entry (the
first of equally near ones) and replaces entries by the floors of their parts' means. Unused entries stay.

Bounds: with each part goes a lower bound of its distance to all entries but its own, and the stamp of the codebook that the bound was
measured against. All codebooks are kept, so a bound is drawn in by how far an entry really is from where it was at
the stamp, the norm of the sum of its moves, and not by the sum of the moves' norms. A part whose distance to its own entry, taken anew,
stays under its bound keeps that entry; only the others are compared with the whole codebook again.

All distances and sums are exact integers. Components beyond +-LIMIT / 256 count as that, so that no sum overflows. Where the length isn't
divisible by PARTS, parts differ by one component in length, or have none. Vectors of each length have codebooks of their own. Left out are
vectors that are null or hold null or non-finite components. A null vec_id is coded like others, and comes last where entries
are chosen; rows of one vec_id are ordered by their vectors. Fewer than ENTRIES vectors make as many entries. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_frequent, written
from .partial import totals

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: The largest integer of a component: squares of 1,000 differences sum up to less than 2**60.
LIMIT = 1 << 24
#: Share by which a bound must exceed a distance before it is believed, as roots are rounded.
MARGIN = 1e-9
#: Parts that are compared with a whole codebook at a time.
PORTION = 8_192

_STATE = "code binary, bound binary, stamp binary"


def cuts(width: int) -> list[slice]:
    """The components of each part."""
    edges = [i * width // PARTS for i in range(PARTS + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def integers(vectors: np.ndarray) -> np.ndarray:
    """Components as integers; products with a power of two are exact."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the entries, exact: the products stay under 2**53, or integers are used."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * top * top * max(1, x.shape[1]) < 1 << 53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    return (np.square(a).sum(1)[:, None] + np.square(b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


@dataclass
class Codebooks:
    """The codebooks of one vector length, from the first to the newest: of each part, entries as rows."""

    width: int
    history: list[list[np.ndarray]]

    def drifts(self, part: int) -> np.ndarray:
        """[stamp, entry]: how far any other entry is at most from where it was at the stamp."""
        now = self.history[-1][part]
        out = np.zeros((len(self.history), len(now)))
        for s, then in enumerate(self.history):
            moved = np.sqrt(np.square((now - then[part]).astype(np.float64)).sum(1))
            first = int(moved.argmax())
            rest = np.delete(moved, first).max(initial=0.0)
            out[s] = moved[first]
            out[s, first] = rest
        return out

    def digest(self) -> str:
        """sha256 of all newest entries' components, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for part in self.history[-1] for x in part.ravel()).encode()).hexdigest()


def assign(x: np.ndarray, books: Codebooks, code: np.ndarray | None = None, bound: np.ndarray | None = None, stamp: np.ndarray | None = None):
    """(code, bound, stamp, squares, rescans) of integer vectors against the newest codebooks: of each vector and part
    its entry, what no other entry is nearer than, the codebook that bound is of, and its squared distance. Given is what an earlier
    codebook's assignment returned, or nothing."""
    n, now, rescans = len(x), len(books.history) - 1, 0
    fresh = code is None
    if fresh:
        code, bound, stamp = np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS), np.float32), np.zeros((n, PARTS), np.uint8)
    code, bound, stamp = code.copy(), bound.copy(), stamp.copy()
    squares = np.zeros((n, PARTS), np.int64)
    for p, cut in enumerate(cuts(books.width)):
        part, entries = x[:, cut], books.history[-1][p]
        if fresh:
            again = np.arange(n)
        else:
            own = code[:, p]
            squares[:, p] = np.square(part - entries[own]).sum(1)
            left = bound[:, p].astype(np.float64) - books.drifts(p)[stamp[:, p], own]
            again = np.flatnonzero(np.sqrt(squares[:, p].astype(np.float64)) * (1 + MARGIN) >= left * (1 - MARGIN))
        for i in range(0, len(again), PORTION):
            at = again[i : i + PORTION]
            far = _squares(part[at], entries)
            best = far.argmin(1)
            squares[at, p], code[at, p], stamp[at, p] = far[np.arange(len(at)), best], best, now
            far[np.arange(len(at)), best] = np.iinfo(np.int64).max
            second = np.sqrt(far.min(1).astype(np.float64)) if len(entries) > 1 else np.full(len(at), 3.0e38)
            bound[at, p] = np.nextafter(second.astype(np.float32), np.float32(0))  # rounded down
        rescans += len(again)
    return code, bound, stamp, squares, rescans


def _state(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, ...]:
    kinds = (np.uint8, np.float32, np.uint8)
    return tuple(np.frombuffer(b"".join(batch.column(first + i).to_pylist()), k).reshape(-1, PARTS) for i, k in enumerate(kinds))


def _blobs(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def updated(state: DataFrame, books: Codebooks) -> list[np.ndarray]:
    """The next codebooks: the floors of the means of the parts in each entry; entries without parts stay."""
    widths = [e.shape for e in books.history[-1]]
    width, most = books.width, max(len(e) for e in books.history[-1])

    def summed(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((most, width + PARTS), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, code = _matrix(batch.column(0), width).astype(np.int64), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, PARTS)
                for p, cut in enumerate(cuts(width)):
                    for d in range(cut.start, cut.stop):
                        total[:, d] += np.bincount(code[:, p], x[:, d], most).astype(np.int64)  # a batch's sums stay exact
                    total[:, width + p] += np.bincount(code[:, p], minlength=most)
        return total

    total = totals(state.select("x", "code"), summed)
    new = []
    for p, cut in enumerate(cuts(width)):
        count = total[: widths[p][0], width + p]
        sums = total[: widths[p][0], cut]
        new.append(np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], books.history[-1][p]))
    return new


def _compressed(valid: DataFrame, width: int) -> tuple[DataFrame, Codebooks, list[int]]:
    """valid(vec_id, label, v) of one length with code and error, its codebooks, and how many parts each round compared anew."""
    first = valid.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()  # ENTRIES rows at most
    start = integers(np.array([r.v for r in first], np.float64).reshape(len(first), width))
    books = Codebooks(width, [[start[:, cut] for cut in cuts(width)]])
    state, scans = None, []
    for last in [False] * ROUNDS + [True]:

        def run(batches: Iterator[pa.RecordBatch], books=books, fresh=state is None, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(2), width)
                x = integers(x) if fresh else x.astype(np.int64)
                code, bound, stamp, squares, rescans = assign(x, books, *(() if fresh else _state(batch, 3)))
                count = np.zeros(len(x), np.int64)
                count[:1] = rescans
                kept = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.astype(np.int32).ravel()))
                rest = [pa.array(squares.sum(1))] if last else [kept, _blobs(bound), _blobs(stamp)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], _blobs(code), pa.array(count), *rest], names=["vec_id", "label", "code", "rescans", *(["error"] if last else ["x", "bound", "stamp"])])

        given = valid.select("vec_id", "label", "v") if state is None else state.select("vec_id", "label", "x", "code", "bound", "stamp")
        label = valid.schema["label"].dataType.simpleString()
        schema = f"vec_id {valid.schema['vec_id'].dataType.simpleString()}, label {label}, code binary, rescans long, "
        after = written(given.mapInArrow(run, schema + ("error long" if last else "x array<int>, bound binary, stamp binary")), "codes-state")
        if state is not None:
            discard(state)
        state = after
        scans.append(state.agg(F.sum("rescans")).first()[0] or 0)
        if not last:
            books = Codebooks(width, [*books.history, updated(state, books)])
    return state.drop("rescans"), books, scans


def finite(vector: Column) -> Column:
    """Whether a vector (array<double>) is given and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def compressed(table: DataFrame) -> list[tuple[DataFrame, Codebooks, list[int]]]:
    """For each length of vectors in table(vec_id, embedding, label): (vec_id, label, code, error) as written, with code a byte for each part; the
    codebooks; and of each round how many parts were compared with a whole codebook."""
    given = table.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    valid = given.where(finite(F.col("v")))
    widths = sorted(r[0] for r in valid.select(F.size("v")).distinct().collect())  # lengths of vectors: a few
    return [_compressed(valid.where(F.size("v") == width), width) for width in widths]


def coded(table: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of table(vec_id, embedding, label): code in hexadecimal digits; label_error
    adds up the errors of a label, of nulls together, whatever the lengths."""
    parts = [rows.withColumn("codebooks_sha256", F.lit(books.digest())) for rows, books, _ in compressed(table)]
    if not parts:
        return table.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionAll(more)
    keyed = rows.withColumn("no_label", F.col("label").isNull()).withColumn("of", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = keyed.groupBy("no_label", "of").agg(F.sum("error").alias("label_error"), F.count("*").alias("many"))
    joined = join_frequent(keyed, sums, ["no_label", "of"], keyed.count())
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")
