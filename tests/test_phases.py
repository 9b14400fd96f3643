"""Phase histograms by enumeration of subsequences."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsketch.functions import maths
from loomsketch.operators import phases


def counted(soft, table):
    """Weight of each phase over all subsequences of soft symbols, as shares."""
    out = np.zeros(table.dim)
    for places in itertools.combinations(range(len(soft)), table.t):
        for codes in itertools.product(range(table.size), repeat=table.t):
            out[sum(table.hashes[q][c] for q, c in enumerate(codes)) % table.dim] += np.prod([soft[i][c] for i, c in zip(places, codes, strict=True)])
    total = np.abs(out).sum()
    return out / total if total else out


def hard(codes, size):
    return np.eye(size)[codes] if len(codes) else np.zeros((0, size))


TABLES = phases.phase_tables(4, 2, 5, 3, 1)


def test_whole_sequences_and_contrasts(spark):
    seqs = {1: [0, 1, 2, 3, 3, 0, 1], 2: [2], 3: [], 4: [1, 1, 1, 9, -1]}
    df = spark.createDataFrame(list(seqs.items()), "seq_id long, seq array<int>")
    rows = df.select("seq_id", phases.histograms(F.col("seq"), TABLES).alias("h"), phases.contrasts(F.col("seq"), TABLES).alias("c"), phases.contrasts(F.col("seq"), TABLES, 8).alias("b")).collect()
    edges = [np.tan(np.pi * ((b + 0.5) / 8 - 0.5)) for b in range(7)]
    for r in rows:
        codes = [c for c in seqs[r.seq_id] if 0 <= c < 4]
        for m, table in enumerate(TABLES):
            expected = counted(hard(codes, 4), table)
            assert np.allclose(r.h[m], expected, atol=1e-12)
            c = sum(x * (-1) ** p for p, x in enumerate(expected))
            assert abs(r.c[m] - c) < 1e-12 and r.b[m] == 1 + sum(e <= r.c[m] for e in edges)


@pytest.mark.parametrize(("window", "stride", "offset", "last"), [(6, 3, 0, True), (5, 4, 1, True), (4, 2, 0, False), (30, 7, 3, True)])
def test_windows(spark, window, stride, offset, last):
    rng = np.random.default_rng(stride)
    seqs = {i: [int(c) for c in rng.integers(0, 4, n)] for i, n in enumerate((0, 1, 4, 12, 25))}
    df = spark.createDataFrame(list(seqs.items()), "seq_id long, seq array<int>")
    found = {(r.seq_id, r.channel, r.win_idx): r.histogram for r in phases.sliding_histograms(df, TABLES, window, stride, offset, last).collect()}
    expected = {}
    for i, seq in seqs.items():
        ends = [e for e in range(1, len(seq) + 1) if e % stride == offset % stride or (last and e == len(seq))]
        for m, table in enumerate(TABLES):
            for n, e in enumerate(ends):
                expected[i, m, n] = counted(hard(seq[max(0, e - window) : e], 4), table)
    assert set(found) == set(expected) and all(np.allclose(found[k], v, atol=1e-12) for k, v in expected.items())


def test_windows_over_chunk_edges(spark):
    seq = [int(c) for c in np.random.default_rng(3).integers(0, 4, 2500)]
    df = spark.createDataFrame([(1, seq)], "seq_id long, seq array<int>")
    rows = {(r.channel, r.win_idx): r.histogram for r in phases.sliding_histograms(df, TABLES[:2], 20, 9, 4).collect()}
    ends = [e for e in range(1, 2501) if e % 9 == 4 or e == 2500]
    assert sorted(n for c, n in rows if c == 0) == list(range(len(ends)))
    for n in (0, 112, 113, 114, 115, 227, 228, len(ends) - 1):
        assert np.allclose(rows[1, n], counted(hard(seq[max(0, ends[n] - 20) : ends[n]], 4), TABLES[1]), atol=1e-12)


def test_soft_sequences_and_levels(spark):
    """Windows' histograms are the next level's symbols; a soft sequence of whole symbols is a plain one."""
    rng = np.random.default_rng(8)
    upper = [phases.phase_tables(5, 2, 3, 2, 20 + c) for c in range(3)]
    seqs = {1: [int(c) for c in rng.integers(0, 4, 20)], 2: [int(c) for c in rng.integers(0, 4, 7)]}
    df = spark.createDataFrame(list(seqs.items()), "seq_id long, seq array<int>")
    first = phases.sliding_histograms(df, TABLES, 6, 2)
    second = phases.soft_histograms(phases.as_soft(first), upper, 4, 2)
    below = {}
    for r in first.collect():
        below.setdefault((r.seq_id, r.channel), {})[r.win_idx] = r.histogram
    found = {(r.seq_id, r.channel, r.win_idx): r.histogram for r in second.collect()}
    expected = {}
    for (i, c), by in below.items():
        soft = np.array([by[n] for n in sorted(by)])
        ends = [e for e in range(1, len(soft) + 1) if e % 2 == 0 or e == len(soft)]
        for e, table in enumerate(upper[c]):
            for n, end in enumerate(ends):
                expected[i, 2 * c + e, n] = counted(soft[max(0, end - 4) : end], table)
    assert set(found) == set(expected) and all(np.allclose(found[k], v, atol=1e-10) for k, v in expected.items())
    flat = {r.seq_id: r.sketch for r in phases.squeezed(second).collect()}
    assert flat[2] == [x for k in sorted(k for k in found if k[0] == 2) for x in found[k]]
    as_soft = spark.createDataFrame([(1, 0, [[float(x) for x in row] for row in hard(seqs[1], 4)])], "seq_id long, channel int, soft array<array<double>>")
    plain = {(r.channel, r.win_idx): r.histogram for r in first.where("seq_id = 1 AND channel = 0").collect()}
    soft = {(r.channel, r.win_idx): r.histogram for r in phases.soft_histograms(as_soft, [TABLES[:1]], 6, 2).collect()}
    assert set(plain) == set(soft) and all(np.allclose(plain[k], soft[k], atol=1e-12) for k in plain)


def test_odd_soft_rows(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 0, []), (3, 9, [[1.0]]), (None, 0, [[1.0]]), (4, 0, [[None, 1.0], None, [0.5]])], "seq_id long, channel int, soft array<array<double>>")
    rows = phases.soft_histograms(df, [TABLES[:1]], 3, 3).collect()
    assert [(r.seq_id, r.win_idx) for r in rows] == [(4, 0)]
    assert np.allclose(rows[0].histogram, counted(np.array([[0, 1, 0, 0], [0] * 4, [0.5, 0, 0, 0]]), TABLES[0]))
    assert phases.squeezed(phases.sliding_histograms(df.select("seq_id", F.array().cast("array<int>").alias("seq")), TABLES, 3, 3)).collect() == []


def test_phase_convolution(spark):
    row = spark.range(1).select(F.array(*map(F.lit, [1.0, 2.0, 3.0])).alias("a"), F.array(*map(F.lit, [0.5, 0.0, 2.0])).alias("w"))
    r = row.select(maths.phase_convolution(F.col("a"), F.col("w"), [0, 1, 2]).alias("x"), maths.circular_convolution(F.col("a"), F.col("w")).alias("y"), maths.phase_convolution(F.col("a"), F.col("w"), [1, 1, 0]).alias("z")).first()
    assert r.x == r.y
    expected = np.zeros(3)
    for i, j in itertools.product(range(3), range(3)):
        expected[(i + [1, 1, 0][j]) % 3] += [1, 2, 3][i] * [0.5, 0, 2][j]
    assert np.allclose(r.z, expected)
