"""Simple-8b coding of unsigned 64-bit ids into a file of segments.

A 64-bit word has a 4-bit selector at its top and 60 bits of data, the first id lowest. Ids of more than 60 bits are
escapes: the word's data is then an index into a list of raw 64-bit values at the segment's end. Ids come in blocks of
BLOCK, each starting a new word, and a table of the blocks' first words lets blocks be decoded in any order; within a
block all words of a selector are decoded at once. A block's last word may hold zeros beyond the block's end.

Segment, little-endian: magic "S8B1", u32 ids in a block, u64 ids, u32 documents, blocks, words and escapes,
then i64 doc_id, u8 "has a doc_id" and u32 number of ids for each document, u32 first word of each block,
u64 words, u64 escapes.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 1024
MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sIQIIII")

# Fixed values of the format: ids in a word and bits of each, by selector. Selector 1 marks an escape.
COUNTS = (240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 1

_LANES = np.array(COUNTS)
_PAD = max(COUNTS)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs; of more than 53, one too many where the value rounds up to a power of two."""
    return np.maximum((ids.astype(np.float64).view(np.int64) >> 52) - 1022, 0).astype(np.uint8)


def _choose(widths: np.ndarray, n: int) -> np.ndarray:
    """The selector that a word starting at each of n places of each row would have: the one that takes most ids."""
    best = np.where(widths[:, :n] > 60, np.uint8(ESCAPE), np.uint8(15))
    peak, reach = widths, 1
    for selector in range(14, -1, -1):
        if selector == ESCAPE:
            continue
        count = COUNTS[selector]
        while reach * 2 <= count:
            peak = np.maximum(peak[:, : peak.shape[1] - reach], peak[:, reach:])
            reach *= 2
        fits = np.maximum(peak[:, :n], peak[:, count - reach : count - reach + n]) <= BITS[selector]
        if not fits.any():  # what doesn't fit here doesn't with more ids of fewer bits
            break
        best = np.where(fits, np.uint8(selector), best)
    return best


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block, and escapes of ids (unsigned)."""
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    grid = np.zeros((blocks, BLOCK + _PAD), ids.dtype)
    full = len(ids) // BLOCK
    grid[:full, :BLOCK] = ids[: full * BLOCK].reshape(full, BLOCK)
    grid[full:, : len(ids) - full * BLOCK] = ids[full * BLOCK :]
    ends = np.full(blocks, BLOCK)
    ends[-1] = len(ids) - (blocks - 1) * BLOCK
    best = _choose(_widths(grid), BLOCK)
    grid, line = grid.ravel(), BLOCK + _PAD
    row, at, chosen, places = np.arange(blocks), np.zeros(blocks, np.int64), [], []
    while len(row):  # the n-th word of every block that has one
        selector = best[row, at[row]]
        chosen.append((row, selector))
        places.append(at[row])
        at[row] += _LANES[selector]
        row = row[at[row] < ends[row]]
    rows, selectors, place = np.concatenate([r for r, _ in chosen]), np.concatenate([s for _, s in chosen]), np.concatenate(places)
    order = np.argsort(rows, kind="stable")
    rows, selectors = rows[order], selectors[order]
    start = rows * line + place[order]
    words = selectors.astype(np.uint64) << np.uint64(60)
    escapes = np.zeros(0, np.uint64)
    for selector in np.unique(selectors):
        mine = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            escapes = grid[start[mine]].astype(np.uint64)
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
            continue
        data = np.zeros(len(mine), np.uint64)
        for lane in range(COUNTS[selector] if BITS[selector] else 0):
            data |= grid[start[mine] + lane].astype(np.uint64) << np.uint64(lane * BITS[selector])
        words[mine] |= data
    return words, np.searchsorted(rows, np.arange(blocks)).astype(np.uint32), escapes


def unpack(words: np.ndarray, firsts: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids of pack()'s result."""
    out = np.zeros(len(firsts) * BLOCK + _PAD, np.uint64)
    if not n:
        return out[:0]
    selectors = (words >> np.uint64(60)).astype(np.int64)
    low = words & np.uint64((1 << 60) - 1)
    before = np.concatenate([[0], np.cumsum(_LANES[selectors])])
    block = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(words))))
    place = before[:-1] - before[firsts][block] + block * BLOCK
    for selector in np.unique(selectors)[::-1]:
        mine = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            out[place[mine]] = escapes[low[mine].astype(np.int64)]
            continue
        mask = np.uint64((1 << BITS[selector]) - 1)
        for lane in range(COUNTS[selector] if BITS[selector] else 0):
            to, value = place[mine] + lane, (low[mine] >> np.uint64(lane * BITS[selector])) & mask
            inside = to < (block[mine] + 1) * BLOCK  # a block's last word may reach beyond its end
            out[to[inside]] = value[inside]
    return out[:n]


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, firsts, escapes = pack(ids)
    return b"".join(
        (
            _HEAD.pack(MAGIC, BLOCK, len(ids), len(doc_ids), len(firsts), len(words), len(escapes)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is not None for d in doc_ids], "u1").tobytes(),
            np.array(lengths, "<u4").tobytes(),
            firsts.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
            escapes.astype("<u8").tobytes(),
        )
    )


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, their numbers of ids, and all ids, of write_segment()'s result."""
    magic, block, n, docs, blocks, words, escapes = _HEAD.unpack_from(data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a segment of this format")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, count, at)
        at += found.nbytes
        return found

    ids, has, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    firsts, packed, rare = take("<u4", blocks), take("<u8", words), take("<u8", escapes)
    return [int(i) if h else None for i, h in zip(ids, has, strict=True)], lengths, unpack(packed, firsts.astype(np.int64), rare, n)
