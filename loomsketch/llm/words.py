"""Words of many texts at once: their bytes, hashes of 64 bits, and hashes of runs of words.

Words are runs of other than ASCII white space (0x20, 0x09 to 0x0D). A word's hash is SipHash under a fixed key; the hash
of a run mixes those of its halves, over and over. They depend on nothing but the bytes, and, unlike polynomials over
2**64, don't agree for texts with a pattern.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Keys of independent word hashes, and odd factors of the hashes of runs.
KEYS = ("loom-of-words-01", "loom-of-words-02")
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words that are hashed together.
PORTION = 500_000
#: Bytes of texts that are taken together; a longer text is taken by itself.
TOGETHER = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of texts (bytes): starts and ends in data, and of each text its words' range in bounds."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts)
        self.raw = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(self.raw) + 2, np.int8)
        inside[1:-1] = ~_SPACE[self.raw]
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(self.starts, at)

    def hashes(self, which: int = 0) -> np.ndarray:
        out = np.zeros(len(self.starts), np.uint64)
        for i in range(0, len(out), PORTION):
            some = self.data[self.starts[i] : self.ends[min(i + PORTION, len(out)) - 1]].split()
            codes, distinct = pd.factorize(np.array(some, object))
            out[i : i + PORTION] = pd.util.hash_array(distinct, hash_key=KEYS[which], categorize=False)[codes]
        return out

    def of_words(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def runs(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of the n words from each word on; the last n - 1 have none."""
    if len(hashes) < n:
        return hashes[:0]
    base, count = np.uint64(BASES[which]), len(hashes) - n + 1
    out, at, step = None, 0, 1
    while True:  # hashes are those of step words here
        if n & step:
            part = hashes[at : at + count]
            out = part if out is None else mixed(out * base + part)
            at += step
        if 2 * step > n:
            return mixed(out + np.uint64(n))
        hashes = mixed(hashes[:-step] * base + hashes[step:])
        step *= 2


def grouped(texts: list[bytes], together: int = TOGETHER):
    """Ranges of texts of so many bytes, or of one longer text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > together:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)
