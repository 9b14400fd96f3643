"""Removing passages that repeat: words in a window of 20 that starts earlier too.

First pass: a window's anchor is the least-hashed run of 8 words in it, so equal windows have equal anchors, and the
number of places that are some window's anchor is at least the number of equal windows. Each partition counts its anchor
places in a count-min sketch of two rows whose counters stop at 2; partition sketches travel as the counters that
aren't 0, chunk by chunk, and are merged by saturating sums. A window whose anchor's counters are below 2 in a row is
certainly single. The sketch's width follows the bytes of the corpus up to WIDEST counters a row; of a corpus beyond that
it says less, so more windows than repeat go on to the second pass, and none is lost. There are two passes at any size.

Second pass: of the other windows, each task keeps the first of those it has met with equal words (equal 96-bit
hashes of them) and knows the later ones to be repeats; so a window that is everywhere costs a row a task. The kept
ones are grouped exactly by hash over all tasks, and all but the earliest are repeats as well. Repeats then meet their
texts, sorted by document, and their words go.

Nulls: a null text has no words; rows with a null doc_id are neither compared nor changed. Of rows with one doc_id,
windows at the same place are equally early, and stay. Texts of fewer than 20 words have no window. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import Words, grouped, mixed, runs

WINDOW, ANCHOR = 20, 8
#: Most counters of a row of the sketch: its two rows of bits are 64 MB, sent to each executor.
WIDEST = 1 << 28
#: Counters of a chunk, in which sketches are merged.
CHUNK = 1 << 20
#: Bytes of text for each counter of a row; a seventh of the words are anchors, of six bytes each and a space.
SPARSE = 16
#: Anchors, and windows, that a task holds at a time.
HELD = 1_500_000
ROWS = 2


def _sliding(values: np.ndarray, n: int, of) -> np.ndarray:
    """of (np.minimum or np.maximum) over each n values in a row."""
    reach = 1
    while 2 * reach <= n:
        values = of(values[: len(values) - reach], values[reach:])
        reach *= 2
    rest = n - reach
    return of(values[: len(values) - rest], values[rest:]) if rest else values


def _windows(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first words of windows inside one text, all windows' anchors, and the runs' hashes."""
    v = runs(hashes, ANCHOR)
    m = _sliding(v, WINDOW - ANCHOR + 1, np.minimum)
    last = np.repeat(words.bounds[1:], np.diff(words.bounds))[: len(m)]
    return np.flatnonzero(np.arange(len(m)) + WINDOW <= last), m, v


def _place(anchors: np.ndarray, row: int, width: int) -> np.ndarray:
    """The anchors' counters in a row."""
    return (mixed(anchors + np.uint64(row + 1)) >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(batch.num_columns - 1).to_pylist()]


def repeated(docs: DataFrame, width: int) -> np.ndarray:
    """Bits of the merged sketch, row by row: the counters that are 2 or more."""
    step = min(CHUNK, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            anchors = np.concatenate(held)
            held.clear()
            for row in range(ROWS):
                at, n = np.unique(_place(anchors, row, width), return_counts=True)
                cuts = np.searchsorted(at, np.arange(0, width + 1, step))
                for c in range(len(cuts) - 1):
                    if cuts[c] < cuts[c + 1]:
                        some, many = (at[cuts[c] : cuts[c + 1]] % step).astype("<u4"), n[cuts[c] : cuts[c + 1]] > 1
                        yield pa.RecordBatch.from_pydict({"chunk": pa.array([row * (len(cuts) - 1) + c], pa.int32()), "once": [some[~many].tobytes()], "more": [some[many].tobytes()]})

        for batch in batches:
            texts = _texts(batch)
            for a, b in grouped(texts):
                words = Words(texts[a:b])
                if len(words.starts) < WINDOW:
                    continue
                inside, m, v = _windows(words, words.hashes())
                least = np.zeros(len(v) + WINDOW - ANCHOR, np.uint64)  # each run's windows start at it or up to 12 before
                least[inside + WINDOW - ANCHOR] = m[inside]
                held.append(v[_sliding(least, WINDOW - ANCHOR + 1, np.maximum) == v])
                if sum(map(len, held)) >= HELD:
                    yield from flush()
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counters = None, np.zeros(step, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"chunk": pa.array([now], pa.int32()), "bits": [np.packbits(counters > 1, bitorder="little").tobytes()]})

        for batch in batches:
            for chunk, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now:
                    if now is not None:
                        yield done()
                    now = chunk
                    counters[:] = 0
                at = np.frombuffer(once, "<u4")
                counters[at] = np.minimum(counters[at] + 1, 2)
                counters[np.frombuffer(more, "<u4")] = 2
        if now is not None:
            yield done()

    parts = docs.where("doc_id is not null").select("text").mapInArrow(count, "chunk int, once binary, more binary")
    merged = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, bits binary")
    size = step // 8
    bits = np.zeros(ROWS * width // 8, np.uint8)
    for row in merged.toLocalIterator():
        bits[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return bits


def _packed(high: np.ndarray, start: np.ndarray, sure: int) -> np.ndarray:
    """32 bits of high, 31 of start and one of sure."""
    top = high.astype(np.uint64) & ~np.uint64(0xFFFFFFFF)
    return (top | (start.astype(np.uint64) << np.uint64(1)) | np.uint64(sure)).view(np.int64)


def _candidates(docs: DataFrame, key: Column, alone: bool, width: int) -> DataFrame:
    """(h, g, doc_id, start), and key unless doc_ids are alone, of the windows that may repeat, the first of each task's
    equal ones under 64 bits in h and 32 at the top of g; and, where g is odd, of ranges that surely go, of as many words
    as g's top says."""
    sent = docs.sparkSession.sparkContext.broadcast(repeated(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h1, h2, doc, key, start = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((start, doc, h2, h1))
            h1, h2, doc, key, start = (x[order] for x in (h1, h2, doc, key, start))
            fresh = np.ones(len(h1), bool)
            fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(h1)), 0))
            late = (doc != doc[first]) | (start != start[first])
            d, k, s = doc[late], key[late], start[late]
            order = np.lexsort((s, k, d))
            d, k, s = d[order], k[order], s[order]
            cut = np.ones(len(d), bool)
            cut[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (s[1:] > s[:-1] + WINDOW)
            at = np.flatnonzero(cut)
            ends = np.append(s, 0)[np.append(at[1:], len(s)) - 1] + WINDOW if len(s) else s
            keep = np.flatnonzero(~late)
            keep = keep[np.lexsort((start[keep], doc[keep]))]  # neighbours compress
            columns = (
                np.concatenate([h1[keep].view(np.int64), mixed(k[at].view(np.uint64) + s[at].astype(np.uint64)).view(np.int64)]),
                np.concatenate([_packed(h2[keep], start[keep], 0), _packed((ends - s[at]) << 32, s[at], 1)]),
                np.concatenate([doc[keep], d[at]]),
                np.concatenate([key[keep], k[at]]),
            )
            for a in range(0, len(columns[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 20_000]) for c in columns], names=["h", "x", "doc_id", "key"])

        for batch in batches:
            texts, ids, keys = _texts(batch), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in grouped(texts):
                words = Words(texts[a:b])
                if len(words.starts) < WINDOW:
                    continue
                hashes = words.hashes()
                inside, m, _ = _windows(words, hashes)
                anchors = m[inside]
                likely = np.ones(len(inside), bool)
                for row in range(ROWS):
                    at = _place(anchors, row, width) + row * width
                    likely &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                inside = inside[likely]
                of = np.searchsorted(words.bounds, inside, side="right") - 1
                other = runs(words.hashes(1), WINDOW, 1)[inside]
                held.append((runs(hashes, WINDOW)[inside], other, ids[a:b][of], keys[a:b][of], inside - words.bounds[of]))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from flush()
        if held:
            yield from flush()

    keyed = docs.where("doc_id is not null").select("doc_id", key.alias("key"), "text")
    start = F.shiftrightunsigned("x", 1).bitwiseAND(0x7FFFFFFF)
    rows = keyed.mapInArrow(run, "h long, x long, doc_id long, key long")
    return rows.select("h", (F.col("x") - start * 2).alias("g"), "doc_id", *([] if alone else ["key"]), start.cast("int").alias("start"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, key, start, end, text), a text before the ranges of its words that go, to what is left."""
    texts: list[tuple[int | None, bytes]] = []
    ranges: list[tuple[np.ndarray, np.ndarray]] = []
    now, out = None, ([], [], [], [])

    def close() -> None:
        for doc, text in texts:
            words = text.split()
            gone = 0
            if ranges:
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, np.concatenate([r[0] for r in ranges]), 1)
                np.add.at(step, np.concatenate([r[1] for r in ranges]), -1)
                stay = np.cumsum(step)[:-1] == 0
                gone = int(len(words) - stay.sum())
                kept = [words[i] for i in np.flatnonzero(stay)]
            else:
                kept = words
            for column, value in zip(out, (doc, len(words), gone, b" ".join(kept).decode()), strict=True):
                column.append(value)
        texts.clear()
        ranges.clear()

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "text"])
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        doc, key, start, end = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        doc = np.where(missing, 0, doc).astype(np.int64)
        change = np.ones(len(doc), bool)
        change[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (missing[1:] != missing[:-1])
        cuts = np.append(np.flatnonzero(change), len(doc))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            me = (bool(missing[a]), int(doc[a]), int(key[a]))
            if me != now:
                close()
                now = me
            n = a + int(np.searchsorted(start[a:b], 0))  # texts have start -1
            texts += [(None if me[0] else me[1], t.encode()) for t in batch.column(4).slice(a, n - a).to_pylist()]
            if n < b:
                ranges.append((start[n:b], end[n:b]))
        if sum(map(len, out[3])) > 4_000_000:
            yield rows()
    close()
    yield rows()


def deduplicated(docs: DataFrame, widest: int = WIDEST) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of docs(doc_id, text): words that an earlier window has are gone, the others are
    joined by single spaces. widest: most counters of a row of the sketch."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(widest, max(1 << 12, 1 << (size // SPARSE).bit_length()))
    ids = docs.where("doc_id is not null").groupBy("doc_id").count()
    alone = not ids.where("count > 1").limit(1).count()
    key = F.lit(0).cast("long") if alone else F.xxhash64("text")  # tells rows of one doc_id apart
    found = _candidates(docs, key, alone, width)
    place = F.struct("doc_id", "start")
    first = F.min(place).over(Window.partitionBy("h", "g"))
    sure = F.col("g").bitwiseAND(1) == 1
    length = F.when(sure, F.shiftrightunsigned("g", 32)).otherwise(WINDOW)
    gone = found.withColumn("first", first).where(sure | (place != F.col("first")))
    gone = gone.select("doc_id", (key if alone else F.col("key")).alias("key"), F.col("start").cast("long").alias("start"), (F.col("start") + length).cast("long").alias("end"), F.lit(None).cast("string").alias("text"))
    texts = docs.select("doc_id", key.alias("key"), F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.coalesce("text", F.lit("")).alias("text"))
    met = texts.unionAll(gone).repartition("doc_id", "key").sortWithinPartitions("doc_id", "key", "start")
    return met.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, text string")
