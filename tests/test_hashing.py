"""Hash families against published values, and as permutations."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from loomsketch.functions import hashing
from loomsketch.plans import engine

WORD = 0xFFFFFFFF


def murmur(data: bytes, seed: int) -> tuple[int, int, int, int]:
    """128-bit MurmurHash3 (x86) as it is published, for any length."""
    rot = lambda x, r: (x << r | x >> 32 - r) & WORD
    c = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
    turns = ((15, 19, 0x561CCD1B), (16, 17, 0x0BCAA747), (17, 15, 0x96CD1C35), (18, 13, 0x32AC3B17))
    h = [seed] * 4
    key = lambda i, k: rot(k * c[i] & WORD, turns[i][0]) * c[(i + 1) % 4] & WORD
    whole = len(data) // 16 * 16
    for at in range(0, whole, 16):
        for i, k in enumerate(struct.unpack("<4I", data[at : at + 16])):
            h[i] = ((rot(h[i] ^ key(i, k), turns[i][1]) + h[(i + 1) % 4]) * 5 + turns[i][2]) & WORD
    for i, k in enumerate(struct.unpack("<4I", data[whole:].ljust(16, b"\0"))):
        h[i] ^= key(i, k) ^ len(data)
    for last in (False, True):
        h[0] = sum(h) & WORD
        h = [h[0], *((x + h[0]) & WORD for x in h[1:])]
        if not last:
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
                h = [(x ^ x >> shift) * factor & WORD for x in h]
    return tuple(h)


def test_murmur_is_the_published_one():
    """The check value that comes with the published code: the hash of the hashes of 0, 0 1, 0 1 2 and so on."""
    hashes = b"".join(struct.pack("<4I", *murmur(bytes(range(i)), 256 - i)) for i in range(256))
    assert murmur(hashes, 0)[0] == 0xB3ECE62A


@pytest.mark.parametrize("seed", [0, 42, WORD])
def test_murmur_columns(spark, seed):
    keys = [0, 1, 2, 77, 2**31, 2**32 - 1, 2**32, 2**40 + 5, 2**63 - 1]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    family = hashing.Murmur3(4, seed)
    for place in (0, 3):
        found = rows.select("k", family.words(place, F.col("k")).alias("w"), family.hash(place, F.col("k")).alias("h")).collect()
        for r in found:
            words = murmur(struct.pack("<QQ", place, r.k), seed)
            assert tuple(r.w) == words
            assert r.h == (words[0] | words[1] << 32) - (1 << 63)


def test_crc32c_is_the_published_one(spark):
    given = {b"123456789": 0xE3069283, b"\0" * 32: 0x8A9136AA, b"\xff" * 32: 0x62A8AB43, bytes(range(32)): 0x46DD794E, b"": 0}
    rows = spark.createDataFrame([(k,) for k in [*map(bytearray, given), None]], "b binary")
    found = [(r.b, r.c) for r in rows.select("b", hashing.crc32c(F.col("b")).alias("c")).collect()]
    assert found == [*((bytearray(k), v) for k, v in given.items()), (None, None)]


def test_crc32c_family_is_the_register_over_key_and_place(spark):
    family = hashing.Crc32c(3, 5)
    keys = [0, 1, 255, 256, 65537, 2**32 - 1, 2**32 + 1]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", *(family.hash(i, F.col("k")).alias(f"h{i}") for i in range(3))).collect()
    one, two = family.seeds()
    of = lambda seed, k, place: hashing.crc32c_word(hashing.crc32c_word(seed, k & WORD), place)
    for r in rows:
        for i in range(3):
            assert r[f"h{i}"] == (of(one, r.k, i) << 4) & WORD | of(two, r.k, i)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 101, 125, 1000, 1009, 4096])
def test_injections_are_permutations(spark, size):
    family = hashing.family("uniform", 3, 9, size)
    a, b = family.sides()
    assert 0 <= a * b - 2 * size < a
    rows = spark.range(2 * size).select(*(family.hash(i, F.col("id")).alias(f"h{i}") for i in range(3))).collect()
    for i in range(3):
        assert sorted(r[f"h{i}"] for r in rows) == list(range(2 * size))
    if size > 60:
        values = [[r[f"h{i}"] for r in rows] for i in range(3)]
        assert values[0] != values[1] != values[2]
        # keys that follow one another are spread: the mean step of random permutations is a third of the range
        steps = sum(abs(x - y) for x, y in zip(values[0], values[0][1:], strict=False)) / (2 * size - 1)
        assert 0.25 * 2 * size < steps < 0.42 * 2 * size


def test_large_ranges_and_keys_outside(spark):
    family = hashing.Injection(1, 4**20, 3)
    rows = spark.range(5000).select(family.hash(0, F.col("id")).alias("h")).collect()
    assert len({r.h for r in rows}) == 5000 and max(r.h for r in rows) < 2 * 4**20 and sum(r.h for r in rows) / 5000 / 4**20 == pytest.approx(1, abs=0.05)
    small = hashing.Injection(1, 10, 3)
    assert spark.range(1).select(small.hash(0, F.lit(None).cast("long")).alias("h")).first().h is None
    with pytest.raises(Exception, match="isn't within"):
        spark.range(21).select(small.hash(0, F.col("id")).alias("h")).collect()
    with pytest.raises(ValueError, match="set of keys"):
        hashing.family("uniform", 1)


@pytest.mark.parametrize("family", ["uniform", "murmur", "crc32"])
@pytest.mark.parametrize("method", ["MH", "WMH", "OMH"])
def test_sketches_under_each_family(spark, family, method):
    """Equal sequences have equal sketches, and those without a common k-mer differ everywhere."""
    p = engine.Parameters(method=method, size=4, kmer_length=2, dim=6, tuple_length=2, hash_family=family, max_len=20)
    rows = spark.createDataFrame([(1, [0, 0, 0, 1, 1, 0]), (2, [0, 0, 0, 1, 1, 0]), (3, [2, 3, 3, 2, 2, 2])], "seq_id long, seq array<int>")
    found = {r.seq_id: r.sketch for r in engine.sketched(rows, p).collect()}
    assert found[1] == found[2] and all(x != y for x, y in zip(found[1], found[3], strict=True))
