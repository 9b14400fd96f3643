"""Families of hash functions over k-mers, one member for each place of a sketch; all are stateless and seeded."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .kmers import let

PRIME = 2147483647


@dataclass(frozen=True)
class Affine:
    """(a[i] key + b[i]) mod a prime of 31 bits: injective for smaller keys, and the same in every SQL engine."""

    places: int
    seed: int = 42
    a: tuple[int, ...] = field(init=False)
    b: tuple[int, ...] = field(init=False)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        object.__setattr__(self, "a", tuple(int(x) for x in rng.integers(1, PRIME, self.places)))
        object.__setattr__(self, "b", tuple(int(x) for x in rng.integers(0, PRIME, self.places)))

    def hash(self, place: int, key: Column) -> Column:
        return (F.lit(self.a[place]).cast("long") * (key % PRIME) + F.lit(self.b[place]).cast("long")) % PRIME


# The five primes of 64-bit xxHash.
_XX = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def _xx_word(state: int, word: int) -> int:
    """64-bit xxHash of a word of 32 bits, from a state: what the hash of several columns goes on from."""
    whole = (1 << 64) - 1
    x = (state + _XX[4] + 4 ^ (word & (1 << 32) - 1) * _XX[0]) & whole
    x = ((x << 23 | x >> 41) * _XX[1] + _XX[2]) & whole
    x = (x ^ x >> 33) * _XX[1] & whole
    x = (x ^ x >> 29) * _XX[2] & whole
    return x ^ x >> 32


@dataclass(frozen=True)
class XxHash:
    """64 bits; the default for real data."""

    places: int
    seed: int = 42

    def hash(self, place: int, key: Column) -> Column:
        return F.xxhash64(F.lit(self.seed), F.lit(place), key)

    def values(self, place: int, keys: np.ndarray) -> np.ndarray:
        """hash() of many keys, whole numbers, by numpy."""
        begun = _xx_word(_xx_word(42, self.seed), place)
        u = np.uint64
        turned = lambda x, by: x << u(by) | x >> u(64 - by)
        x = turned(keys.astype(np.int64).view(u) * u(_XX[1]), 31) * u(_XX[0])
        x = turned(u((begun + _XX[4] + 8) % (1 << 64)) ^ x, 27) * u(_XX[0]) + u(_XX[3])
        x = (x ^ x >> u(33)) * u(_XX[1])
        x = (x ^ x >> u(29)) * u(_XX[2])
        return (x ^ x >> u(32)).view(np.int64)


_WORD = (1 << 32) - 1

# The polynomial of CRC-32C in reflected form.
_CASTAGNOLI = 0x82F63B78


def _crc32c_table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (_CASTAGNOLI if byte & 1 else 0)
        out.append(byte)
    return out


CRC32C_TABLE = _crc32c_table()


def crc32c_word(state: int, word: int) -> int:
    """The register after four more bytes, the lowest of word first, without inversion before or after."""
    for i in range(4):
        state = state >> 8 ^ CRC32C_TABLE[(state ^ word >> 8 * i) & 255]
    return state


def _numbers(values) -> Column:
    return F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")


def crc32c(data: Column) -> Column:
    """CRC-32C of binary data: a fold over its bytes."""
    table, digits = _numbers(CRC32C_TABLE), F.hex(data)
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    step = lambda state, i: F.shiftright(state, 8).bitwiseXOR(F.get(table, state.bitwiseXOR(byte(i)).bitwiseAND(F.lit(255)).cast("int")))
    places = F.when(F.length(data) > 0, F.sequence(F.lit(0), F.length(data) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(data.isNotNull(), F.aggregate(places, F.lit(_WORD).cast("long"), step).bitwiseXOR(F.lit(_WORD)))


@dataclass(frozen=True)
class Crc32c:
    """CRC-32C over a key's low word, then the place, begun from two seeds: the first register by 16, or'ed with the second, 32 bits.

    The register is linear in its bits, so a place's value is the key's, from four table look-ups, with a constant mixed in;
    quick, and weak for that reason.
    """

    places: int
    seed: int = 42

    def seeds(self) -> tuple[int, int]:
        return tuple(int(x) for x in np.random.default_rng([self.seed, 32]).integers(0, 1 << 32, 2))

    def constants(self, place: int) -> tuple[int, int]:
        """What place and seeds mix into both registers."""
        return tuple(crc32c_word(crc32c_word(s, 0), place) for s in self.seeds())

    @staticmethod
    def tables() -> list[list[int]]:
        """For each byte of a key, what its values put into the register after the key and an empty place."""
        return [[crc32c_word(crc32c_word(0, b << 8 * i), 0) for b in range(256)] for i in range(4)]

    def hash(self, place: int, key: Column) -> Column:
        of = None
        for i, table in enumerate(self.tables()):
            found = F.get(_numbers(table), F.shiftright(key.cast("long"), 8 * i).bitwiseAND(F.lit(255)).cast("int"))
            of = found if of is None else of.bitwiseXOR(found)
        one, two = self.constants(place)
        return let(of, lambda x: F.shiftleft(x.bitwiseXOR(F.lit(one)), 4).bitwiseAND(F.lit(_WORD)).bitwiseOR(x.bitwiseXOR(F.lit(two))))


# The multipliers of the four lanes, and by lane the turns of its key and of itself and what is added, of 128-bit
# MurmurHash3 in words of 32 bits; the multipliers of its last mixing.
_LANES = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
_TURNS = ((15, 19, 0x561CCD1B), (16, 17, 0x0BCAA747), (17, 15, 0x96CD1C35), (18, 13, 0x32AC3B17))
_LAST = (0x85EBCA6B, 0xC2B2AE35)


def _times(x: Column, c: int) -> Column:
    """A product of words of 32 bits, by halves of the factor, as a long would overflow."""
    return let(x, lambda v: (v * (c & 0xFFFF) + F.shiftleft((v * (c >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_WORD)))


def _turned(x: Column, by: int) -> Column:
    return let(x, lambda v: F.shiftleft(v, by).bitwiseAND(F.lit(_WORD)).bitwiseOR(F.shiftright(v, 32 - by)))


def _lane(i: int, own: int, following: int, key: int) -> int:
    """A lane after its key, all numbers."""
    turn = lambda x, by: (x << by | x >> 32 - by) & _WORD
    key = turn(key * _LANES[i] & _WORD, _TURNS[i][0]) * _LANES[(i + 1) % 4] & _WORD
    return ((turn(own ^ key, _TURNS[i][1]) + following) * 5 + _TURNS[i][2]) & _WORD


def _lane_of(i: int, own: int, following: int, key: Column) -> Column:
    """The same of a Column's words."""
    key = _times(_turned(_times(key, _LANES[i]), _TURNS[i][0]), _LANES[(i + 1) % 4])
    return (_times((_turned(key.bitwiseXOR(F.lit(own)), _TURNS[i][1]) + following).bitwiseAND(F.lit(_WORD)), 5) + _TURNS[i][2]).bitwiseAND(F.lit(_WORD))


def _avalanche(x: Column) -> Column:
    fold = lambda x, by: let(x, lambda v: v.bitwiseXOR(F.shiftright(v, by)))
    return fold(_times(fold(_times(fold(x, 16), _LAST[0]), 13), _LAST[1]), 16)


def _spread(words: Column) -> Column:
    """The sum of all words first, then the others with it added."""
    total = F.aggregate(words, F.lit(0).cast("long"), lambda s, x: s + x).bitwiseAND(F.lit(_WORD))
    return let(total, lambda t: F.transform(words, lambda x, i: F.when(i == 0, t).otherwise((x + t).bitwiseAND(F.lit(_WORD)))))


@dataclass(frozen=True)
class Murmur3:
    """128-bit MurmurHash3 (x86) of place and key as 64-bit words: its first 64 bits, as a long in the order of the unsigned numbers."""

    places: int
    seed: int = 42

    def words(self, place: int, key: Column) -> Column:
        """All four words of 32 bits. What place and seed alone make of two lanes is worked out beforehand."""
        seed = self.seed & _WORD
        one = _lane(0, seed, seed, place & _WORD)
        two = _lane(1, seed, seed, place >> 32)
        low, high = key.cast("long").bitwiseAND(F.lit(_WORD)), F.shiftrightunsigned(key.cast("long"), 32)
        lanes = F.array(F.lit(one).cast("long"), F.lit(two).cast("long"), _lane_of(2, seed, seed, low), _lane_of(3, seed, one, high))
        begun = let(F.transform(lanes, lambda x: x.bitwiseXOR(F.lit(16))), _spread)
        return let(F.transform(begun, _avalanche), _spread)

    def hash(self, place: int, key: Column) -> Column:
        return let(self.words(place, key), lambda w: (F.get(w, F.lit(1)) - (1 << 31)) * (1 << 32) + F.get(w, F.lit(0)))


@dataclass(frozen=True)
class Injection:
    """A keyed permutation of [0, 2 * set_size) for each place: distinct keys have distinct values, without a table.

    Feistel rounds turn a number into its remainder and quotient by a side near the root, and add to each in turn a function of the other,
    modulo its side. Where the sides' product exceeds the range by a few, a value beyond it goes round again, at
    most once more than there are such values.
    """

    places: int
    set_size: int
    seed: int = 42

    ROUNDS = 4

    @property
    def range(self) -> int:
        return 2 * self.set_size

    def sides(self) -> tuple[int, int]:
        """Both sides, at least 1; of those about the root the pair with the least excess."""
        root = max(1, math.isqrt(self.range))
        spread = range(max(1, root // 2), min(self.range, 2 * root) + 1) if root < 4096 else range(root - 2048, root + 2049)
        return min(((a, -(-self.range // a)) for a in spread), key=lambda s: (s[0] * s[1] - self.range, abs(s[0] - s[1])))

    def constants(self, place: int) -> list[tuple[int, int, int, int]]:
        """Of each round, factor and addend for both sides' functions."""
        rng = np.random.default_rng([self.seed, place, 7])
        return [tuple(int(x) for x in rng.integers(1, PRIME, 4)) for _ in range(self.ROUNDS)]

    def hash(self, place: int, key: Column) -> Column:
        a, b = self.sides()
        excess = a * b - self.range
        rounds = F.expr("array(" + ", ".join(f"array({', '.join(f'{x}L' for x in r)})" for r in self.constants(place)) + ")")

        def of(x: Column, factor: Column, addend: Column) -> Column:
            return let((x * factor + addend) % PRIME, lambda y: F.shiftright(y * y, 10))

        def step(state: Column, r: Column) -> Column:
            left = F.pmod(state["l"] + of(state["r"], F.get(r, F.lit(0)), F.get(r, F.lit(1))), F.lit(a))
            return let(F.struct(left.alias("l"), state["r"].alias("r")), lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + of(s["l"], F.get(r, F.lit(2)), F.get(r, F.lit(3))), F.lit(b)).alias("r")))

        def once(x: Column) -> Column:
            start = F.struct(F.pmod(x, F.lit(a)).alias("l"), F.call_function("div", x, F.lit(a)).alias("r"))
            return F.aggregate(rounds, start, step, lambda s: s["r"] * a + s["l"])

        value = once(key.cast("long"))
        if excess:
            value = F.aggregate(F.sequence(F.lit(1), F.lit(excess)), value, lambda x, _: F.when(x >= self.range, once(x)).otherwise(x))
        fits = (key >= 0) & (key < self.range)
        return F.when(fits, value).when(key.isNotNull(), F.raise_error(F.lit(f"a key isn't within [0, {self.range})")))


@dataclass(frozen=True)
class Preset:
    """A table of values by place and key, for tests; keys outside it hash to themselves."""

    table: tuple[tuple[int, ...], ...]

    @property
    def places(self) -> int:
        return len(self.table)

    def hash(self, place: int, key: Column) -> Column:
        return F.coalesce(F.get(F.array(*(F.lit(x).cast("long") for x in self.table[place])), key.cast("int")), key.cast("long"))


def tabled(spark: SparkSession, family, set_size: int) -> Preset:
    """A family over a small set of keys as a table, which a job makes of the set: a look-up then takes the place of hashing each occurrence."""
    if set_size > 4096:
        raise ValueError("the set is too large for a table in a plan")
    keys = spark.range(set_size).select("id", *(family.hash(i, F.col("id")).alias(f"h{i}") for i in range(family.places)))
    rows = sorted(keys.collect())  # a row for each key there may be
    return Preset(tuple(tuple(r[i + 1] for r in rows) for i in range(family.places)))


FAMILIES = {"affine": Affine, "xxhash64": XxHash, "murmur": Murmur3, "crc32": Crc32c}


def family(name: str, places: int, seed: int = 42, set_size: int | None = None):
    """The family of a name; "uniform" draws from twice the set_size keys there may be."""
    if name.lower() == "uniform":
        if not set_size:
            raise ValueError("the uniform family needs the size of the set of keys")
        return Injection(places, set_size, seed)
    try:
        return FAMILIES[name.lower()](places, seed)
    except KeyError:
        raise ValueError(f"unknown hash family {name!r}; known are uniform, {', '.join(FAMILIES)}") from None


@dataclass(frozen=True)
class TensorTables:
    """For tuple length t over an alphabet: hashes[t][size] in [0, dim) and signs[t][size] of 1 and -1."""

    hashes: tuple[tuple[int, ...], ...]
    signs: tuple[tuple[int, ...], ...]
    dim: int

    @classmethod
    def drawn(cls, size: int, t: int, dim: int, seed: int = 42) -> TensorTables:
        rng = np.random.default_rng([seed, size, t, dim])
        h = rng.integers(0, dim, (t, size))
        s = 2 * rng.integers(0, 2, (t, size)) - 1
        return cls(tuple(tuple(map(int, r)) for r in h), tuple(tuple(map(int, r)) for r in s), dim)

    @property
    def t(self) -> int:
        return len(self.hashes)

    @property
    def size(self) -> int:
        return len(self.hashes[0])

    def mirrored(self) -> TensorTables:
        """The tables whose sketch is this one's with places turned round: rotations go the other way."""
        return TensorTables(tuple(tuple(-x % self.dim for x in r) for r in self.hashes), self.signs, self.dim)
