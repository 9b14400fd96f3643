"""Whitening against eigenvectors by numpy and exact integers."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsketch.llm import queries, whitening
from loomsketch.llm.partial import totals

TABLE = "vec_id long, embedding array<float>, label int"


def turned(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize(
    "a",
    [
        turned(np.random.default_rng(1).random(64) * 1e6),
        turned([1] * 7 + [2] * 7 + [3, 3 + 1e-9]),
        turned([0] * 20 + [1e6, 5, 3]),
        turned([0, 1, 2]),  # the mean is an eigenvalue
        turned(10.0 ** -np.arange(0, 16, 0.5)),
        np.eye(6),
        np.zeros((5, 5)),
        np.diag([1.0, 3.0, 2.0]),
        np.array([[4.0]]),
    ],
)
def test_spectrum(a):
    values, vectors = whitening.spectrum(a)
    size = np.linalg.norm(a) or 1.0
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
    assert np.linalg.norm(a @ vectors - vectors * values) < 1e-13 * size


def test_polar_factor():
    a = turned([5, 2, -1, -1e-9, 1e-12, -7])
    u = whitening.polar(a)
    assert np.abs(u @ u - np.eye(6)).max() < 1e-13 and round(float(np.trace(u))) == 0


def plain(vectors):
    x = np.floor(1024 * vectors.astype(float)) + 100_000
    n, sums = len(x), [int(s) for s in x.astype(np.int64).astype(object).sum(0)]
    off = x - np.array(sums, float) / n
    values, axes = np.linalg.eigh(off.T @ off / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x], off @ axes / np.sqrt(values), values / values.sum()


def test_whitening_against_numpy(spark):
    sf = "/root/testdata/sf0.01"
    given = duckdb.execute(f"select vec_id, embedding from '{sf}/embeddings.parquet' order by vec_id").fetchall()
    n, deviations, white, explained = plain(np.array([v for _, v in given], np.float32))
    rows = queries.op13_whitening(spark, sf).collect()
    assert len(rows) == 8 * len(given) and {r.n for r in rows} == {n}
    assert len({r.identity_error for r in rows}) == 1 and 0 <= rows[0].identity_error < 1e-9
    found = {(r.vec_id, r.component): r for r in rows}
    for c in range(8):
        got = np.array([found[i, c + 1].whitened for i, _ in given])
        sign = np.sign(got @ white[:, c])
        assert np.abs(got - sign * white[:, c]).max() < 1e-8
        assert all(abs(found[i, c + 1].explained / explained[c] - 1) < 1e-9 for i, _ in given)
    assert [found[i, 1].deviation for i, _ in given] == deviations


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(4)], i) for i in range(40)]
    rows += [(None, [0.5, 0.5, 0.25, 1.0], 0), (7, rows[7][1], 7), (100, None, 1), (101, [float("nan")] * 4, 1), (102, [None] * 4, 1), (103, [], 1), (104, [1.0, 2.0], 1), (105, [1.0, 2.0], 1), (106, [3.0], 1), (107, [5.0], 1)]
    table = spark.createDataFrame(rows, TABLE).repartition(5).withColumn("n", F.lit("x")).withColumn("v", F.lit("x"))
    found = whitening.components_of(table).collect()
    four = [r for r in found if r.vec_id is None or r.vec_id < 100]
    assert len(four) == 42 * 4 and {r.n for r in four} == {42} and max(r.identity_error for r in four) < 1e-9
    assert len({r.whitened for r in four if r.vec_id == 7 and r.component == 1}) == 1
    equal = [r for r in found if r.vec_id in (104, 105)]
    assert len(equal) == 4 and all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, 0.0, None, 0) for r in equal)
    single = {r.vec_id: r for r in found if r.vec_id in (106, 107)}
    assert abs(single[106].whitened + single[107].whitened) < 1e-12 and abs(abs(single[106].whitened) - 1) < 1e-12 and single[106].explained == 1
    assert not {100, 101, 102, 103} & {r.vec_id for r in found}
    assert whitening.components_of(table.limit(0)).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**30 + i), float(i % 3)], 0) for i in range(9)]
    found = {r.vec_id: r for r in whitening.components_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).where("component = 1").collect()}
    x = [[(1024 * (2**30 + i)) + 100_000, 1024 * (i % 3) + 100_000] for i in range(9)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert [found[i].deviation for i in range(9)] == [sum((9 * v - s) ** 2 for v, s in zip(x[i], sums, strict=True)) for i in range(9)]


def test_totals_of_many_partitions(spark):
    """More partitions than one task adds up, of which some are empty."""
    table = spark.range(0, 1000, 1, 150).where("id < 900")

    def summed(batches):
        out = np.zeros(2, np.int64)
        for b in batches:
            ids = b.column(0).to_numpy()
            out += [len(ids), ids.sum()]
        return out

    assert totals(table, summed).tolist() == [900, 899 * 450]
