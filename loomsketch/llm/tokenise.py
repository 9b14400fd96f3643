"""Texts to token ids with a public tokenizer, word by word.

Both tokenizers cut a text at white space before they merge, so a text may be split at every single space between two
other characters, and each piece encoded by itself, with its space before it. A worker keeps the ids of the pieces it
has met, by their bytes, as most words come again; those that don't come again go when there are too many. Both also cut
between letters, signs and line feeds, so a new piece of Latin letters, signs after them and single line feeds is put
together from its runs, which are fewer than pieces and kept in the same way. New runs go through the tokenizer many to a
text where ids keep spaces, as a run begins with each token that begins with one, and else to the tokenizer's model by
themselves. Other new pieces go through the whole tokenizer. A text whose spaces stand beside other white space is split
with more care.
"""

from __future__ import annotations

import json
import re
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Pieces, and runs, that a worker remembers; the longest piece, in bytes, that is put together from its runs.
REMEMBERED, LONGEST = 500_000, 64
#: Bytes of texts that are encoded together; new pieces that are a text for the tokenizer, and such texts that it gets at once.
TOGETHER, PIECES, TEXTS = 4_000_000, 512, 64

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_SPACE, _LETTER, _SIGN, _LINE, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = _LETTER  # 0xC3 begins the letters from 0xC0 to 0xFF
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _SIGN
_KIND[0x20], _KIND[0x0A] = _SPACE, _LINE
#: What may follow what in a piece of runs: no letters after signs, which may be of a contraction or a special token.
_FOLLOWS = np.zeros((5, 5), bool)
for _a, _b in ((_SPACE, (_LETTER, _SIGN)), (_LETTER, (_LETTER, _SIGN, _LINE, _SPACE)), (_SIGN, (_SIGN, _LINE, _SPACE)), (_LINE, (_LETTER, _SIGN))):
    _FOLLOWS[_a, list(_b)] = True
_workers: dict[tuple[str, int | None], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the others for 256 onward."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in itself)
    return {b: chr(b) for b in itself} | {b: chr(256 + n) for n, b in enumerate(others)}


def _flat(ids: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each list has, -1 for None, and all ids."""
    return np.array([-1 if x is None else len(x) for x in ids], np.int64), np.array([y for x in ids if x for y in x], "<u4")


def _sums(counts: np.ndarray) -> np.ndarray:
    """What is before each, and in all."""
    return np.concatenate([[0], np.cumsum(np.maximum(counts, 0))]).astype(np.int64)


class Known:
    """The ids of keys that a worker has met, and how many, -1 for a key without ids of its own."""

    def __init__(self, most: int | None = None):
        self.most = most  # keys that stay, REMEMBERED if None
        self.at: dict[bytes, int] = {}
        self.firsts = self.counts = np.zeros(0, np.int64)  # a key's ids in pool
        self.again = np.zeros(1, bool)  # of each key, and at last of unknown ones
        self.pool = np.zeros(1 << 16, "<u4")
        self.used = 0

    def thin(self) -> None:
        """Of more keys than are remembered those that came again stay, or none if they are too many."""
        most = REMEMBERED if self.most is None else self.most
        if len(self.at) <= most:
            return
        stay = np.flatnonzero(self.again[:-1])
        if len(stay) > most // 4 * 3:
            stay = stay[:0]
        names, counts, (ids, _) = list(self.at), self.counts[stay], self.ids(stay)
        self.__init__(self.most)
        self.add([names[i] for i in stay.tolist()], counts, ids)

    def places(self, keys: list[bytes]) -> np.ndarray:
        """-1: unknown."""
        found = np.fromiter(map(self.at.get, keys, repeat(-1)), np.int64, len(keys))
        self.again[found] = True
        return found

    def add(self, keys: list[bytes], counts: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at.update(zip(keys, range(len(self.at), len(self.at) + len(keys)), strict=True))
        self.firsts, self.counts = np.append(self.firsts, self.used + _sums(counts)[:-1]), np.append(self.counts, counts)
        self.again = np.append(self.again[:-1], np.zeros(len(keys) + 1, bool))
        self.used += len(ids)

    def learnt(self, data: np.ndarray, bounds: np.ndarray, learn) -> np.ndarray:
        """The places of the keys that bounds cut data into; learn gives the counts and ids of distinct unknown keys."""
        self.thin()
        cut = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        keys = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self.places(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            found[missing] = len(self.at) + np.arange(len(missing))
            fresh = [keys[i] for i in missing.tolist()]
            self.add(fresh, *learn(fresh))
        return found[cut.indices.to_numpy()]

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the places, and how many are before each place and in all."""
        counts = np.maximum(self.counts[places], 0)
        before = _sums(counts)
        return self.pool[np.repeat(self.firsts[places] - before[:-1], counts) + np.arange(before[-1])], before


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, without special tokens."""

    def __init__(self, path: str, remembered: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.lower = '"Lowercase"' in json.dumps(json.load(f)["normalizer"])
        self.letters = _byte_letters()
        self.spaced = "" if self.lower else self.letters[0x20]  # the lower-casing one drops white space
        known = self.tokenizer.get_vocab()
        self.opens, self.breaks = (np.zeros(max(known.values()) + 1, bool) for _ in range(2))  # ids of tokens that begin with a space; that are a line feed
        self.opens[[i for token, i in known.items() if self.spaced and token.startswith(self.spaced)]] = True
        self.breaks[[i for token, i in known.items() if token == self.letters[0x0A]]] = True
        self.words = 0  # runs that went to the model by themselves
        self.pieces, self.runs = Known(remembered), Known(remembered)  # pieces but those that texts begin with have their space before them

    def _whole(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _by_model(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of runs that the tokenizer's own splitting leaves whole."""
        tokenize, letters = self.model.tokenize, self.letters
        self.words += len(runs)
        return _flat([[t.id for t in tokenize(run.decode("latin-1").translate(letters))] for run in runs])

    def _joined(self, texts: list[str], between: str, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Counts and ids of many pieces or runs in one text, each with what is put between them before it: each begins with the next token of begins."""
        lines = [between + between.join(texts[at : at + PIECES]) for at in range(0, len(texts), PIECES)]
        found = [np.zeros(0, "<u4")]
        for at in range(0, len(lines), TEXTS):
            found += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(lines[at : at + TEXTS], add_special_tokens=False)]
        ids = np.concatenate(found)
        firsts = np.flatnonzero(begins[ids])
        if len(firsts) != len(texts):  # a vocabulary whose tokens don't tell
            return None
        return np.diff(np.append(firsts, len(ids))), ids

    def _learn_runs(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not self.spaced:
            return self._by_model(runs)
        spaced = np.array([r[0] == 0x20 for r in runs])
        after = np.array([r[0] not in b" \n" for r in runs])
        found = self._joined([r[1:].decode() for r in runs if r[0] == 0x20], " ", self.opens)
        others = self._joined([r.decode() for r in runs if r[0] not in b" \n"], "\n", self.breaks)
        if found is None or others is None:
            return self._by_model(runs)
        counts = np.ones(len(runs), np.int64)
        counts[spaced], counts[after] = found[0], others[0] - 1
        ids = np.full(counts.sum(), np.flatnonzero(self.breaks)[0], "<u4")  # a line feed's, where nothing else is put
        ids[np.repeat(spaced, counts)] = found[1]
        ids[np.repeat(after, counts)] = others[1][~self.breaks[others[1]]]
        return counts, ids

    def _of_runs(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pieces, all with a space before them, are runs alone, and their counts and ids."""
        data = np.frombuffer(b"".join(pieces) + b" ", np.uint8)
        kind = _KIND[data]
        kind[1:][(data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))] = _OTHER  # signs among the letters
        spaces = np.flatnonzero(data == 0x20)
        plain = np.logical_and.reduceat(_FOLLOWS[kind[:-1], kind[1:]], spaces[:-1]) & (np.diff(spaces) <= LONGEST)
        edge = kind[1:] != kind[:-1]
        starts, ends = np.flatnonzero(edge & (kind[1:] != _SPACE)) + 1, np.flatnonzero(edge & (kind[:-1] != _SPACE)) + 1
        owner = np.searchsorted(spaces, starts) - 1
        wanted = plain[owner]
        if self.lower:  # white space is dropped
            wanted &= kind[starts] != _LINE
            capital = (data >= 0x41) & (data <= 0x5A)
            capital[1:] |= (data[:-1] == 0xC3) & (data[1:] <= 0x9E)
            data = data + (capital * np.uint8(0x20))
        else:
            starts = starts - (kind[starts - 1] == _SPACE)
        starts, ends, owner = starts[wanted], ends[wanted], owner[wanted]
        bounds = _sums(ends - starts)
        data = data[np.repeat(starts - bounds[:-1], ends - starts) + np.arange(bounds[-1])]
        places = self.runs.learnt(data, bounds, self._learn_runs)
        counts = np.bincount(owner, self.runs.counts[places], len(pieces)).astype(np.int64)
        return plain, counts[plain], self.runs.ids(places)[0]

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of distinct pieces; -1 where white space ends a piece, or follows the space before it, or nothing does."""
        inner = np.array([p[0] == 0x20 for p in pieces])
        first, inner = np.flatnonzero(~inner), np.flatnonzero(inner)
        counts, parts = np.full(len(pieces), -1, np.int64), []
        if len(inner):
            plain, many, ids = self._of_runs([pieces[i] for i in inner.tolist()])
            counts[inner[plain]] = many
            parts.append((inner[plain], ids))
            others = inner[~plain]
            texts = [pieces[i][1:].decode() for i in others.tolist()]
            good = [i for i, t in enumerate(texts) if t and t == t.strip()]
            texts = [texts[i] for i in good]
            found = (self._joined(texts, " ", self.opens) if self.spaced else None) or _flat(self._whole([" " + t for t in texts]))
            counts[others[good]] = found[0]
            parts.append((others[good], found[1]))
        texts = [pieces[i].decode() for i in first.tolist()]
        good = [i for i, t in enumerate(texts) if not t[-1].isspace()]
        found = _flat(self._whole([texts[i] for i in good]))
        counts[first[good]] = found[0]
        parts.append((first[good], found[1]))
        before, out = _sums(counts), np.zeros(np.maximum(counts, 0).sum(), "<u4")
        for at, ids in parts:
            many = counts[at]
            out[np.repeat(before[at] - _sums(many)[:-1], many) + np.arange(len(ids))] = ids
        return counts, out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; memory follows the longest text or TOGETHER bytes."""
        out: list[np.ndarray] = []
        some, size = [], 0
        for t in texts:
            data = t.encode()
            if size + len(data) + 1 > TOGETHER:
                out += self._together(some)
                some, size = [], 0
            if len(data) >= TOGETHER:
                out.append(self._carefully(t))
            else:
                some.append(data)
                size += len(data) + 1
        return out + self._together(some)

    def _carefully(self, text: str) -> np.ndarray:
        pieces = _BETWEEN.split(text)
        found = [self._whole([pieces[0]])[0]]
        for at in range(1, len(pieces), 4096):
            found += self._whole([" " + p for p in pieces[at : at + 4096]])
        return np.concatenate([np.array(x, "<u4") for x in found])

    def _together(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = _sums(np.array([len(t) for t in texts], np.int64))
        cut = np.append(data == 0x20, True)
        cut[at] = True  # a text that begins with a space has no other piece there
        bounds = np.flatnonzero(cut)
        places = self.pieces.learnt(data, bounds, self._learn)
        odd = _sums(self.pieces.counts[places] < 0)
        ids, before = self.pieces.ids(places)
        at = np.searchsorted(bounds, at)
        odd, before = odd[at], before[at]
        return [self._carefully(t.decode()) if odd[i] < odd[i + 1] else ids[before[i] : before[i + 1]] for i, t in enumerate(texts)]


def encoder(path: str, remembered: int | None = None) -> Encoder:
    """The Python worker's encoder for a vocabulary file; remembered: pieces, and runs, REMEMBERED if None."""
    if (path, remembered) not in _workers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _workers[path, remembered] = Encoder(path, remembered)
    return _workers[path, remembered]
