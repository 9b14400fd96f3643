"""Pairs in the order of their distance, packed on their way: places and ranks against a plain sort."""

from __future__ import annotations

import itertools
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsketch.functions import blocks
from loomsketch.operators import ordered, pairs
from loomsketch.plans import catalog

L1 = lambda a, b: blocks.rounded(blocks.l1(a, b), 6)


def expected(rows, sign=1):
    """[(group, i, j, dist)] in order, NaN after numbers and null last."""
    out = []
    for (i, g, v), (j, h, w) in itertools.combinations(sorted(rows), 2):
        if g is None or g != h:
            continue
        d = None if v is None or w is None else sign * round(sum(abs(x - y) for x, y in zip(v, w)), 6)
        out.append((g, i, j, d))
    key = lambda d: (2, 0.0) if d is None else (1, 0.0) if math.isnan(d) else (0, d)
    return sorted(out, key=lambda p: (key(p[3]), p[1], p[2])), key


def given(kind):
    """Vectors of a few whole numbers, so ties are in many parts, and copies; vectors of digits; and such with null, NaN and large ones."""
    rng = np.random.default_rng(9)
    vectors = [[float(x) for x in rng.integers(0, 3, 4)] for _ in range(45)] + [[1.0, 1.0, 1.0, 1.0]] * 25
    if kind == "digits":
        vectors = [[float(x) for x in np.round(rng.standard_normal(4), 3)] for _ in range(70)]
    if kind == "odd":
        vectors[:6] = [None, [math.nan, 0.0, 0.0, 0.0], [1e9, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0], [1e15, 0.0, 0.0, 0.0], None]
    return [(7 * k - 100, (None, "x", "y")[k % 3 if k < 40 else 1], v) for k, v in enumerate(vectors)]


@pytest.mark.parametrize("kind", ["ties", "digits", "odd"])
@pytest.mark.parametrize("part", [30, 1 << 21])
def test_places_and_ranks(spark, monkeypatch, kind, part):
    monkeypatch.setattr(ordered, "PART", part)
    monkeypatch.setattr(ordered, "BATCH", 100)
    monkeypatch.setattr(pairs, "COMPARED_ROWS", 12)
    rows = given(kind)
    df = spark.createDataFrame(rows, "id long, g string, v array<double>").repartition(3)
    wanted, key = expected(rows)
    found = ordered.placed(df, "id", "v", blocks.arrays, L1, "g", 6).collect()
    assert len(found) == len(wanted)
    plain = lambda d: "nan" if d is not None and math.isnan(d) else d
    assert [(r.g, r.i, r.j, plain(r.dist)) for r in sorted(found, key=lambda r: r.place)] == [(*p[:3], plain(p[3])) for p in wanted]
    assert sorted(r.place for r in found) == list(range(1, len(wanted) + 1))
    wanted, key = expected(rows, -1)
    first, ties = {}, Counter(key(p[3]) for p in wanted)
    for at, p in enumerate(wanted):
        first.setdefault(key(p[3]), at)
    ranks = {p[1:3]: first[key(p[3])] + (ties[key(p[3])] + 1) / 2 for p in wanted}
    got = ordered.rank_matrix(df, "id", "v", blocks.arrays, L1, "g", 6).collect()
    assert len(got) == 2 * len(wanted) and {(r.i, r.j): r.rank for r in got} == ranks | {(j, i): r for (i, j), r in ranks.items()}


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, "x", [1.0]), (2, None, [1.0]), (3, None, [2.0])], "id long, g string, v array<double>")
    assert ordered.placed(df, "id", "v", blocks.arrays, L1, "g", 6).count() == 0
    assert ordered.rank_matrix(df.limit(0), "id", "v", blocks.arrays, L1, "g", 6).count() == 0


def test_a_pair_moves_in_few_bytes_and_once(spark, tmp_path, monkeypatch):
    """What goes to parts is less than a third of the numbers i, j and dist of a pair, and both who counts and who ranks read the same shuffle. Rows of 40 bytes
    and more went before, twice."""
    monkeypatch.setattr(ordered, "PART", 20_000)
    rng = np.random.default_rng(10)
    rows = [(i, i % 2, [float(x) for x in rng.standard_normal(8)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>").repartition(3)
    dealt = ordered._dealt(df, "id", "v", blocks.arrays, L1, "g", 6, True, -1)
    n, size, parts = dealt.agg(F.sum("_n"), F.sum(F.octet_length("_payload")), F.count_distinct("_part")).first()
    assert n == 2 * 600 * 599 // 2 and parts >= 8 and size < 8 * n
    made = ordered.rank_matrix(df, "id", "v", blocks.arrays, L1, "g", 6)
    made.collect()
    assert "ReusedExchange" in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rank_matrix", "sorted_pairs"])
def test_queries_against_their_sql(spark, sf, name):
    connection = duckdb.connect()
    files = f"{sf}/embeddings.parquet" + ("/*.parquet" if os.path.isdir(f"{sf}/embeddings.parquet") else "")
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{files}'")
    wanted = sorted(connection.sql(catalog.ORACLES[name]).fetchall())
    found = catalog.QUERIES[name](spark, sf)
    assert found.columns == connection.sql(catalog.ORACLES[name]).columns
    assert sorted(map(tuple, found.collect())) == wanted
