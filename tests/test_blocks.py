"""Blocks compared by numpy: every pair once, with the values that the Columns give."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomsketch.functions import blocks, distances, hashing
from loomsketch.operators import pairs, phylogeny, stats
from loomsketch.sources import results

GIVEN = [[1.5, -2.0, 0.25], [0.0000005, 7.0], [], None, [1.0, None, 3.0], [float("nan"), 1.0, 2.0], [3.0, 2.0, 1.0, None]] + [[float(x) for x in np.random.default_rng(k).standard_normal(64)] for k in range(12)]
TEXTS = ["", None, "abc", "ABÑ", "kitten", "sitting"] + ["".join("ABCDE"[c] for c in np.random.default_rng(n).integers(0, 5, n)) for n in (1, 63, 64, 65, 99, 127, 128, 129, 200)]


def plain_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("name", ["l1", "l2_squared", "l2", "median_absolute"])
def test_as_the_columns(spark, name):
    """Arrays of several lengths, empty, null and with nulls, in blocks of three rows, as by a join."""
    df = spark.createDataFrame([(i, i % 2, v) for i, v in enumerate(GIVEN)], "id long, g int, v array<double>").repartition(3)
    column = F.round(getattr(distances, name)(F.col("v_i"), F.col("v_j")), 6)
    expected = {(r.g, r.i, r.j): r.d for r in pairs.in_group(df, "id", "g", ["v"]).select("g", "i", "j", column.alias("d")).collect()}
    met = pairs.compared(df, "id", "v", blocks.arrays, lambda a, b: [blocks.rounded(getattr(blocks, name)(a, b), 6)], "d double", group="g", rising=True, rows=3)
    found = met.collect()
    nan = lambda x: "nan" if x is not None and np.isnan(x) else x
    assert len(found) == len(expected)
    assert {(r.g, r.i, r.j): nan(r.d) for r in found} == {k: nan(d) for k, d in expected.items()}


def test_edit_distances_of_all_pairs(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, s string").repartition(2)
    for rows in (2, 100):
        found = pairs.compared(df, "id", "s", blocks.strings, lambda a, b: [blocks.edit(a, b)], "dist int", rows=rows).collect()
        assert len(found) == len(TEXTS) * (len(TEXTS) - 1) // 2 and all(r.j < r.i for r in found)
        for r in found:
            a, b = TEXTS[r.i], TEXTS[r.j]
            assert r.dist == (None if a is None or b is None else plain_edit(a, b))


def test_bits_of_negative_words_and_unequal_places():
    a = blocks.arrays(pa.array([[-1], [5], [-(1 << 63)], None]))
    assert blocks.bit_hamming(a, a).tolist() == [[0, 62, 63, None], [62, 0, 3, None], [63, 3, 0, None], [None] * 4]
    k = blocks.arrays(pa.array([[1, 2, 3], [1, 5, 3], [9, 9]]))
    assert blocks.hamming(k, k).tolist() == [[0, 1, 2], [1, 0, 2], [2, 2, 0]]


def test_rounded_as_written():
    given = np.array([[0.0000005, 0.0000015, 1.0000025, 2.5, 1e18, np.inf, 123456.1234565]])
    assert blocks.rounded(given, 6).tolist() == [[0.000001, 0.000002, 1.000003, 2.5, 1e18, np.inf, 123456.123457]]


def test_a_set_without_rows_or_pairs(spark):
    empty = spark.createDataFrame([], "id long, g int, v array<double>")
    alone = spark.createDataFrame([(1, 1, [1.0]), (2, None, [1.0]), (3, None, [1.0])], "id long, g int, v array<double>")
    of = lambda a, b: [blocks.l1(a, b)]
    assert pairs.compared(empty, "id", "v", blocks.arrays, of, "d double").count() == 0
    assert pairs.compared(alone, "id", "v", blocks.arrays, of, "d double", group="g").count() == 0


def test_lines_strip_by_strip_are_those_of_pairs(spark, tmp_path, monkeypatch):
    """Strips of a few lines, one after the other, against lines from a row for each pair; nulls too."""
    monkeypatch.setattr(results, "MOST_LINES", 3)
    rng = np.random.default_rng(5)
    rows = [(i, f"n{i}", [float(x) for x in rng.integers(0, 4, 6)] if i != 4 else None) for i in range(17)]
    df = spark.createDataFrame(rows, "i long, name string, s array<double>").repartition(3)
    for compression in (None, "gzip"):
        path = str(tmp_path / f"lines-{compression}")
        results.write_lines(df, "s", blocks.arrays, blocks.l2_squared, path, compression)
        sides = df.alias("a").join(df.alias("b"), F.col("b.i") < F.col("a.i"), "left")
        met = sides.select("a.i", F.col("b.i").alias("j"), distances.l2_squared(F.col("a.s"), F.col("b.s")).alias("dist"), "a.name")
        results.write_triangle(met, str(tmp_path / "pairs"))
        read = lambda p: [r.value for r in spark.read.text(p).select("value", F.col("_metadata.file_name").alias("f")).orderBy("f").collect()]
        assert read(path) == read(str(tmp_path / "pairs"))
        assert len(read(path)) == 18


def test_trees_of_rows_are_those_of_their_pairs(spark):
    """Vectors of whole numbers, so many distances are equal; a tree of one and rows without one are left out."""
    rng = np.random.default_rng(6)
    rows = [(3 * i, ("x", "y", None)[i % 3] if i else "z", [float(v) for v in rng.integers(0, 3, 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, tree string, v array<double>").repartition(3)
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy("tree").orderBy("id")) - 1)
    met = pairs.in_group(placed, "place", "tree", ["v"])
    expected = phylogeny.trees(met.select("tree", F.col("j").alias("i"), F.col("i").alias("j"), distances.l2(F.col("v_i"), F.col("v_j")).alias("dist")))
    found = phylogeny.trees_of(df, "tree", "id", "v", blocks.arrays, blocks.l2)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())) and found.columns == expected.columns


@pytest.mark.parametrize("family", [hashing.Murmur3(2, 7), hashing.Injection(2, 125, 7), hashing.Crc32c(2, 7)])
def test_a_table_of_hashes(spark, family):
    known, keys = hashing.tabled(spark, family, 125), spark.range(125)
    assert keys.where((known.hash(1, F.col("id")) != family.hash(1, F.col("id"))) | (known.hash(0, F.col("id")) != family.hash(0, F.col("id")))).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_pairs_are_ranked_by_one_sort(spark, parts):
    """Ties within a range and across many, NaN, nulls; without a join of pairs with their ranks."""
    rng = np.random.default_rng(parts)
    rows = [(i, 1000 + i, v) for i, v in enumerate([*map(float, rng.integers(0, 6, 150)), *[3.0] * 200, float("nan"), float("nan"), None, 1e9, -0.0])]
    df = spark.createDataFrame(rows, "i long, j long, dist double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        expected = {(r.i, r.j): r.rank for r in stats.fractional_rank(df.where("dist IS NOT NULL").withColumn("_d", -F.col("dist")), "_d").collect()}
        found = stats.rank_matrix(df, "dist")
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.i, r.j): r.rank for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 2 * len(expected) == 2 * 354
    assert {k: r for k, r in got.items() if k[0] < k[1]} == expected and all(got[j, i] == r for (i, j), r in expected.items())
    assert stats.rank_matrix(df.limit(0), "dist").count() == 0
