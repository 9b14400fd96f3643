"""Files to a triangle of distances, by the command line's flags; transforms of nested arrays; letters as codes."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from loomsketch.functions import alphabet, distances, maths
from loomsketch.plans import triangle
from loomsketch.sources import results


def test_flags_long_and_short():
    a, p = triangle.parameters("-i in -m OMH -k 4 -t 2 --embed_dim 6 --max_len 50 -s 3 -w 9 --alphabet protein --hash uniform".split())
    assert (p.method, p.kmer_length, p.tuple_length, p.dim, p.max_len, p.stride, p.window, p.size, p.hash_family) == ("OMH", 4, 2, 6, 50, 3, 9, 26, "uniform")
    b, q = triangle.parameters("-i in --sketch_method TSB --tuple_length 4 --block_size 2 --kmer_length 1".split())
    assert (q.block, q.method, b.each, b.o) == (2, "TSB", "file", None)
    with pytest.raises(ValueError, match="block"):
        triangle.parameters("-i in -t 3 --block_size 2".split())
    with pytest.raises(SystemExit):
        triangle.parameters(["-m", "TS"])


def test_one_sequence_a_file(spark, tmp_path):
    seqs = {"b.fa": "ACGTACGTAC", "a.fa": "ACGTTCGTACAA", "c.fa": "TTTTTTTT"}
    for name, letters in seqs.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(f">{name} x\n{letters[:6]}\n{letters[6:]}\n")
    _, p = triangle.parameters(["-i", "x", "-m", "ED"])
    out = triangle.sketch_files(spark, str(tmp_path / "in"), p)
    assert out == str(tmp_path / "in") + ".ED"
    text = "".join(f.read_text() for f in sorted((tmp_path / "in.ED").glob("part-*"))).splitlines()
    assert text[0] == "\t3" and [line.split("\t")[0] for line in text[1:]] == ["a.fa", "b.fa", "c.fa"]
    found = {r.name: r.distances for r in results.read_triangle(spark, out).collect()}
    pairs = [("b.fa", "a.fa"), ("c.fa", "a.fa"), ("c.fa", "b.fa")]
    exact = [spark.range(1).select(distances.edit(F.lit(seqs[x]), F.lit(seqs[y])).alias("d")).first().d for x, y in pairs]
    assert found["a.fa"] == [] and found["b.fa"] + found["c.fa"] == exact
    meta = json.loads("".join(f.read_text() for f in (tmp_path / "in.ED.meta").glob("part-*")))
    assert meta["sketch_method"] == "ED" and meta["embed_dim"] == 4
    (tmp_path / "in" / "c.fa").write_text(">one\nAC\n>two\nAC\n")
    with pytest.raises(Exception, match="more than one sequence in c.fa"):
        triangle.sketch_files(spark, str(tmp_path / "in"), p, str(tmp_path / "again"))


def test_transforms_of_nested_arrays(spark):
    row = spark.range(1).select(F.array(F.array(F.array(F.lit(0.5), F.lit(-2.0)), F.array(F.lit(0.0))), F.array().cast("array<array<double>>")).alias("v"))
    r = row.select(maths.transformed(F.col("v"), "atan", depth=3).alias("a"), maths.transformed(F.col("v"), "disc", 4, depth=3).alias("d"), maths.transformed(F.col("v"), "none", depth=3).alias("n")).first()
    edges = maths.bin_edges(4)
    assert r.a == [[[math.atan(0.5), math.atan(-2.0)], [0.0]], []]
    assert r.d == [[[1 + sum(e <= x for e in edges) for x in c] for c in [[0.5, -2.0], [0.0]]], []] and r.n == [[[0.5, -2.0], [0.0]], []]


def test_letters_from_a_on(spark):
    r = spark.range(1).select(alphabet.alphabet("letters").encode(F.lit("AZb-")).alias("c")).first()
    assert r.c == [0, 25, 26, 26]
