"""Vector code compression against plain integers."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsketch.llm import codes, queries

TABLE = "vec_id long, embedding array<float>, label int"


def plain(rows, width):
    """code, error, label_error by vec_id and the codebooks' digest, with Python's integers."""
    kept = {i: ([int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    w = width // 16
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(kept[i][0], p) for i in sorted(kept)[:64]] for p in range(16)]

    def nearest(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)) for e in books[p]]
        return min(range(len(d)), key=lambda e: (d[e], e)), min(d)

    for _ in range(2):
        met = [[[] for _ in books[p]] for p in range(16)]
        for v, _ in kept.values():
            for p in range(16):
                met[p][nearest(v, p)[0]].append(part(v, p))
        books = [[[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for e, m in zip(books[p], met[p], strict=True)] for p in range(16)]
    found = {i: [nearest(v, p) for p in range(16)] for i, (v, _) in kept.items()}
    error = {i: sum(d for _, d in f) for i, f in found.items()}
    of_label = {}
    for i, (_, label) in kept.items():
        of_label[label] = of_label.get(label, 0) + error[i]
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for e, _ in found[i]), error[i], of_label[kept[i][1]], digest) for i in kept}


@pytest.mark.parametrize(("n", "width"), [(150, 16), (30, 32), (1, 16), (90, 48)])
def test_codes_against_plain_integers(spark, n, width):
    rng = np.random.default_rng(n)
    rows = [(int(i * 7 - 20), [float(x) for x in np.round(rng.standard_normal(width), rng.integers(0, 3))], None if i % 5 == 0 else int(i % 3)) for i in range(n)]
    rows += [(9001, None, 1), (9002, [float("nan")] * width, 1), (9003, [None] * width, 1), (9004, [float("inf")] * width, None)]
    table = spark.createDataFrame(rows, TABLE).repartition(3)
    found = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.coded(table).collect()}
    assert found == plain(rows, width)


def test_bounds_save_rescans_and_change_nothing():
    """Codebooks that move there and back: with bounds and stamps the assignment is that without, and fewer parts are compared anew."""
    rng = np.random.default_rng(2)
    x = codes.integers(rng.standard_normal((40, 32))[rng.integers(0, 40, 2000)] + 0.02 * rng.standard_normal((2000, 32)))
    books = codes.Codebooks(32, [[x[:40, c] for c in codes.cuts(32)]])
    state = codes.assign(x, books)
    for step in (6, -6, 3, 0):
        moved = [e + step for e in books.history[-1]]
        books = codes.Codebooks(32, [*books.history, moved])
        fresh, state = codes.assign(x, books), codes.assign(x, books, *state[:3])
        assert (fresh[0] == state[0]).all() and (fresh[3] == state[3]).all()
        assert state[4] < 0.7 * fresh[4] == 0.7 * 16 * 2000
    # after 6, -6, 3, 0 the entries are 3 away from where they began, and 15 moves long
    assert books.drifts(0)[0].max() == pytest.approx(3 * 2**0.5)


def test_ties_go_to_the_first_entry_and_large_numbers_stay_exact():
    x = np.array([[1 << 24] * 32, [-(1 << 24)] * 32, [0] * 32, [0] * 32], np.int64)
    books = codes.Codebooks(32, [[x[:, c] for c in codes.cuts(32)]])
    code, _, _, squares, _ = codes.assign(x, books)
    assert code[:, 0].tolist() == [0, 1, 2, 2] and not squares.any()
    assert codes.assign(x[:1], codes.Codebooks(32, [[x[1:2, c] for c in codes.cuts(32)]]))[3].sum() == 32 * (1 << 25) ** 2
    assert codes.integers(np.array([1e30, -1e30, -0.001, 0.999])).tolist() == [1 << 24, -(1 << 24), -1, 255]


def test_codes_of_odd_tables(spark, sf):
    rows = [(None, [0.5] * 16, None), (1, [0.25] * 16, 1), (1, [0.25] * 16, 1), (2, [], 2), (3, [1.0] * 17, 3), (4, [2.0] * 17, 3), (5, [], None)]
    table = spark.createDataFrame(rows, TABLE).withColumn("code", F.lit(1)).withColumn("part", F.lit("x")).withColumn("error", F.lit("e"))
    found = codes.coded(table).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in found) == [(False, 1), (False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (True, 0)]
    assert all(r.error == 0 and len(r.code) == 32 for r in found)
    assert codes.coded(table.limit(0)).collect() == []
    assert codes.coded(spark.createDataFrame([(1, None, 1)], TABLE)).count() == 0


def test_every_row_of_the_table_is_coded(spark, sf):
    assert queries.op12_codes(spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
