"""Packing documents into training sequences by best-fit decreasing.

A document's ids are first cut into full windows, and its rest is a piece. A task gathers POOL ids of pieces, takes them
from the longest to the shortest, and puts each into the open window with the least room that still holds it; a segment
tree over remaining capacities finds that window in as many steps as a window's length has bits. What is open at a
pool's end is packed again with the next pool's pieces. If that is more than half a pool, as where pieces are longer than half a window,
and at a task's end, its pieces are laid one after the other and cut where a window is full: so each pool closes half of its ids at least, and
a task leaves one window with padding. No shuffle: sequence ids are unique, and made of the task's number and the window's number within it.

Null and empty texts are a piece with the end id alone. Repeated rows are packed each by itself. No documents give no
pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokenise import encoder

#: Ids that a task packs at a time.
POOL = 1 << 23
#: A window that is at least so full is closed at a pool's end.
CLOSED = 0.98
#: Documents that are encoded at a time, and pieces or runs that the encoder remembers: beside a pool, a worker has to stay small.
STEP, REMEMBERED = 256, 250_000

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Rooms:
    """Open windows by remaining capacity, 0 to most, under a segment tree of their numbers."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: dict[int, list[int]] = {}

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def add(self, room: int, window: int) -> None:
        self.windows.setdefault(room, []).append(window)
        self._change(room, 1)

    def tightest(self, length: int) -> int | None:
        """The least room of length or more, or None."""
        node = length + self.leaves
        if self.count[node]:
            return length
        while node > 1:  # up to a right neighbour that has windows
            if not node & 1 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.leaves:  # and down to its least
            node = 2 * node + (not self.count[2 * node])
        return node - self.leaves

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.windows[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """The pieces' numbers by window, in the order they lie there. No length exceeds window."""
    rooms, packed = Rooms(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = rooms.tightest(lengths[i])
        if room is None:
            room, at = window, len(packed)
            packed.append([])
        else:
            at = rooms.take(room)
        packed[at].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], at)
    return packed


def cut_to_fit(pieces: list[tuple], window: int) -> list[list[tuple]]:
    """Pieces (doc_id, start, doc_tokens, ids) one after the other, cut where a window is full; only the last window may not be."""
    out: list[list[tuple]] = []
    room = 0
    for doc, start, tokens, ids in pieces:
        at = 0
        while at < len(ids):
            if not room:
                out.append([])
                room = window
            some = ids[at : at + room]
            out[-1].append((doc, start + at, tokens, some))
            at, room = at + len(some), room - len(some)
    return out


def pack(docs: DataFrame, vocabulary: str, *, window: int = 4096, end_id: int = 2, pool: int = POOL) -> DataFrame:
    """A row (doc_id, start, length, doc_tokens, sequence_id, offset, ids) for each piece of docs(doc_id, text).

    start counts the document's ids before the piece, offset the sequence's; ids are little-endian u32. A sequence's
    pieces lie side by side from 0; what is left up to window is padding.
    """
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, number, pieces, size = encoder(vocabulary, REMEMBERED), TaskContext.get().partitionId() << 32, [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, pieces, size
            rows, rest = [], []

            def close(members: list[tuple]) -> None:
                nonlocal number
                at = 0
                for doc, start, tokens, ids in members:
                    rows.append((doc, start, len(ids), tokens, number, at, ids))
                    at += len(ids)
                number += 1

            for places in best_fit_decreasing([len(p[3]) for p in pieces], window):
                members = [pieces[i] for i in places]
                if sum(len(p[3]) for p in members) < CLOSED * window:
                    rest += members
                else:
                    close(members)
            size = sum(len(p[3]) for p in rest)
            if last or 2 * size > pool:  # pieces that don't go together: they are cut, so that a pool never stays full
                *full, rest = cut_to_fit(rest, window) or [[]]
                for members in full + ([rest] if last and rest else []):
                    close(members)
                size = sum(len(p[3]) for p in rest)
            pieces = rest
            for at in range(0, len(rows), 512):
                yield _batch(rows[at : at + 512])

        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                some = batch.slice(at, STEP)
                for doc, ids in zip(some.column(0).to_pylist(), encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids = np.append(ids, end)
                    tokens = len(ids)
                    for start in range(0, tokens, window):
                        pieces.append((doc, start, tokens, ids[start : start + window]))
                    size += tokens
                    if size >= pool:
                        yield from flush(last=False)
                pa.default_memory_pool().release_unused()
        yield from flush(last=True)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Ids become bytes here, so that a pool's aren't held twice."""
    rows = [(*row, ids.tobytes()) for *row, ids in rows]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
