"""Goldens and properties of sketches, distances, statistics and clustering."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsketch.functions import alphabet, distances, hashing, kmers, maths
from loomsketch.operators import hashed, phylogeny, stats, tensors
from loomsketch.streaming import sketches


def one(spark, **columns):
    """Expressions over one row of arrays."""

    def run(*exprs):
        base = spark.range(1).select(*(F.array(*map(F.lit, v)).cast(t).alias(k) for k, (v, t) in columns.items()))
        row = base.select(*(e.alias(f"e{i}") for i, e in enumerate(exprs))).first()
        return tuple(row)

    return run


def identity(places, keys=200):
    return hashing.Preset(tuple(tuple((k - i) % keys for k in range(keys)) for i in range(places)))


def test_minhash_goldens(spark):
    seq = [*range(3, 16), *range(3)]
    family = identity(3, 16)
    run = one(spark, k=(seq, "array<bigint>"), twice=(seq * 2, "array<bigint>"), none=([], "array<bigint>"))
    mh, again, turned, empty, weighted = run(
        hashed.minhash(F.col("k"), family), hashed.minhash(F.col("twice"), family), hashed.minhash(F.reverse("k"), family),
        hashed.minhash(F.col("none"), family), hashed.weighted_minhash(F.col("none"), family, 16),
    )
    assert mh == again == turned == [0, 1, 2]
    assert empty == weighted == [0, 0, 0]


def test_weighted_minhash_limits_repeats(spark):
    family = hashing.Affine(2)
    run = one(spark, k=([1, 1, 2], "array<bigint>"))
    assert len(run(hashed.weighted_minhash(F.col("k"), family, 16, 2))[0]) == 2
    with pytest.raises(Exception, match="more than 1"):
        run(hashed.weighted_minhash(F.col("k"), family, 16, 1))


def test_ordered_minhash_goldens(spark):
    family = identity(2)
    seq = list(range(64))
    run = one(spark, k=(seq, "array<bigint>"), short=([1, 2], "array<bigint>"))
    ahead, back = run(hashed.ordered_minhash(F.col("k"), family, 64, 3), hashed.ordered_minhash(F.reverse("k"), family, 64, 3))
    assert ahead == [[0, 1, 2], [1, 2, 3]]
    assert [t[::-1] for t in back] == ahead
    with pytest.raises(Exception, match="fewer than 3"):
        run(hashed.ordered_minhash(F.col("short"), family, 64, 3))


def test_kmers_are_little_endian(spark):
    run = one(spark, s=([1, 2, 3, 0], "array<int>"), short=([1], "array<int>"))
    assert run(kmers.kmers(F.col("s"), 2, 4), kmers.kmers(F.col("short"), 2, 4)) == ([1 + 8, 2 + 12, 3], [])
    with pytest.raises(ValueError):
        kmers.check_fits(4, 32)


def test_hash_families_are_functions(spark):
    for name in ("affine", "xxhash64", "crc32"):
        family = hashing.family(name, 2)
        rows = spark.range(96).select(family.hash(0, F.col("id")).alias("a"), family.hash(1, F.col("id")).alias("b"), family.hash(0, F.col("id")).alias("c")).collect()
        assert all(r.a == r.c for r in rows) and any(r.a != r.b for r in rows)
        assert len({r.a for r in rows}) == 96
    with pytest.raises(ValueError):
        hashing.family("other", 1)


GOLDEN = hashing.TensorTables(((1, 2, 3, 0), (2, 0, 1, 3)), ((1, -1, 1, 1), (-1, 1, 1, -1)), 4)


def test_tensor_sketch_golden(spark):
    run = one(spark, s=([0, 1, 2, 3, 0, 1], "array<int>"), dirty=([0, 9, 1, 2, -1, 3, 0, 1], "array<int>"), short=([1], "array<int>"))
    value, dirty, short, arrow = run(*(tensors.tensor_sketch(F.col(c), GOLDEN) for c in ("s", "dirty", "short")), tensors.arrow_sketch(F.col("s"), GOLDEN))
    assert np.allclose(value, [1 / 15, 1 / 5, -2 / 15, -1 / 15])
    assert np.allclose(dirty, value) and np.allclose(arrow, value)
    assert short == [0, 0, 0, 0]


def closed_form(seq, tables, block=1):
    out, n, m = np.zeros(tables.dim), 0, tables.t // block
    for starts in itertools.combinations(range(len(seq) - block + 1), m):
        if all(b - a >= block for a, b in itertools.pairwise(starts)):
            at = [s + j for s in starts for j in range(block)]
            out[sum(tables.hashes[i][seq[p]] for i, p in enumerate(at)) % tables.dim] += math.prod(tables.signs[i][seq[p]] for i, p in enumerate(at))
            n += 1
    return out / max(n, 1)


@pytest.mark.parametrize(("t", "block"), [(1, 1), (3, 1), (4, 2), (3, 3)])
def test_folds_equal_closed_forms(spark, t, block):
    rng = np.random.default_rng(t)
    seqs = [[int(x) for x in rng.integers(0, 5, n)] for n in (0, 2, 5, 9, 12)]
    tables = hashing.TensorTables.drawn(5, t, 6, 1)
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, s array<int>")
    rows = df.select("id", tensors.tensor_block(F.col("s"), tables, block).alias("a"), tensors.arrow_sketch(F.col("s"), tables, block).alias("b")).collect()
    for r in rows:
        assert np.allclose(r.a, closed_form(seqs[r.id], tables, block), atol=1e-9)
        assert np.allclose(r.b, r.a, atol=1e-9)


def test_single_subsequence_and_constant_sequence(spark):
    for t in (2, 4):
        tables = hashing.TensorTables.drawn(4, t, 5, 3)
        run = one(spark, s=([0, 1, 2, 3][:t], "array<int>"), c=([2] * 7, "array<int>"))
        single, constant = run(tensors.tensor_sketch(F.col("s"), tables), tensors.tensor_sketch(F.col("c"), tables))
        for v in (single, constant):
            assert sorted(np.round(np.abs(v), 9)) == [0, 0, 0, 0, 1]


def test_slide_equals_sketches_of_windows(spark):
    tables = hashing.TensorTables.drawn(4, 3, 5, 2)
    seq = [0, 1, 2, 3, 3, 2, 1, 0, 2, 2, 1, 3]
    df = spark.createDataFrame([(1, seq), (2, [1]), (3, [])], "seq_id long, seq array<int>")
    rows = {(r.seq_id, r.win_idx): r.sketch for r in tensors.windows_sketched(df, tables, 4, 4).collect()}
    assert set(rows) == {(1, 0), (1, 1), (1, 2)}
    for i in range(3):
        assert np.allclose(rows[1, i], closed_form(seq[4 * i : 4 * i + 4], tables))


def test_embedding_counts_and_merges(spark):
    seq = [0, 2, 1, 1, 0, 2]
    run = one(spark, s=(seq, "array<int>"), a=(seq[:2], "array<int>"), b=(seq[2:], "array<int>"))
    whole, plain, merged = run(tensors.embedding(F.col("s"), 3, 2), tensors.embedding(F.col("s"), 3, 2, normalize=False), F.get(tensors.joined(tensors.embedding_state(F.col("a"), 3, 2), tensors.embedding_state(F.col("b"), 3, 2), 3, 2), F.lit(2)))
    counts = [sum(1 for x, y in itertools.combinations(seq, 2) if (x, y) == p) for p in tensors.all_tuples(3, 2)]
    assert plain == merged == counts
    assert np.allclose(whole, np.array(counts) / 15)
    assert sketches.counted(seq, 3, 2)[2].tolist() == counts
    assert sketches.merged(sketches.counted(seq[:2], 3, 2), sketches.counted(seq[2:], 3, 2))[2].tolist() == counts


def test_distances(spark):
    run = one(spark, a=([1.0, 5.0, 2.0], "array<double>"), b=([2.0, 2.0, 2.0, 9.0], "array<double>"), x=([1, 2, 3, 4], "array<int>"), y=([2, 4, 3], "array<int>"), none=([], "array<int>"))
    a, b, x, y, none = map(F.col, ("a", "b", "x", "y", "none"))
    got = run(distances.l1(a, b), distances.l2_squared(a, b), distances.l2(a, b), distances.median_absolute(a, b), distances.hamming(x, y), distances.lcs(x, y), distances.lcs_distance(x, y), distances.lcs(x, none), distances.dtw(a, a), distances.edit(distances.as_letters(x), distances.as_letters(y)))
    assert got == (4.0, 10.0, math.sqrt(10), 1.0, 2, 2, 3, 0, 0.0, 3)
    bits = one(spark, p=([5, 0], "array<bigint>"), q=([6, 1], "array<bigint>"))
    assert bits(distances.bit_hamming(F.col("p"), F.col("q"))) == (3,)


def test_maths(spark):
    assert [maths.int_pow(b, e) for b in range(3) for e in range(3)] == [1, 0, 0, 1, 1, 1, 1, 2, 4]
    run = one(spark, v=([1.0, 2.0, 3.0], "array<double>"), w=([0.0, 1.0, 0.0], "array<double>"))
    v, w = F.col("v"), F.col("w")
    assert run(maths.rotated(v, F.lit(1)), maths.circular_convolution(v, w), maths.is_ascending(v), maths.in_range(v, 0, 3), maths.binomial(F.lit(5), 2), maths.binomial(F.lit(1), 2)) == ([3, 1, 2], [3, 1, 2], True, False, 10, 0)
    edges = maths.bin_edges(4)
    assert run(maths.discretize(v, 4))[0] == [1 + sum(e <= x for e in edges) for x in (1, 2, 3)]
    assert np.allclose(run(maths.transformed(v, "atan"))[0], np.arctan([1, 2, 3]))
    assert run(maths.elementwise(v, w, "+"))[0] == [1, 3, 3]


def test_alphabets(spark):
    df = spark.createDataFrame([("acGTn-",), (None,), ("",)], "s string")
    rows = df.select(*(alphabet.alphabet(n).encode(F.col("s")).alias(n) for n in ("dna4", "dna5", "protein", "upper_dna"))).collect()
    assert rows[0].dna4 == [0, 1, 2, 3, 5, 5] and rows[0].dna5 == [1, 2, 3, 4, 0, 5]
    assert rows[0].protein == [0, 2, 6, 19, 13, 25] and rows[0].upper_dna == [4, 4, 2, 3, 4, 4]
    assert rows[1].dna4 is None and rows[2].dna4 == []
    kept = df.select(alphabet.UPPER_DNA.encode_known(F.col("s")).alias("k")).first().k
    assert kept == [2, 3]
    assert one(spark, s=([0, 0, 1], "array<int>"))(alphabet.reverse_complement(F.col("s")), alphabet.DNA4.decode(F.col("s"))) == ([2, 3, 3], "AAC")
    with pytest.raises(ValueError):
        alphabet.alphabet("rna")


@pytest.mark.parametrize("distinct", [50, 6])
def test_spearman_is_the_correlation_of_ranks(spark, distinct):
    rng = np.random.default_rng(distinct)
    a = rng.integers(0, distinct, 40).astype(float)
    b = a + rng.integers(-3, 4, 40)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a double, b double")
    rank = lambda x: [(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x]
    assert stats.spearman(df, "a", "b").first().spearman == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1], abs=1e-9)


def test_ranks_and_curves(spark):
    df = spark.createDataFrame([(float(x),) for x in (7, 2, 7, 7, 4, 2)], "x double")
    assert sorted(r.rank for r in stats.fractional_rank(df, "x").collect()) == [1.5, 1.5, 3, 5, 5, 5]
    rows = [(0.1, False), (0.4, True), (0.4, False), (0.9, True)]
    scored = spark.createDataFrame(rows, "s double, p boolean")
    brute = np.mean([(x > y) + 0.5 * (x == y) for x, p in rows if p for y, q in rows if not q])
    assert stats.auroc(scored, "s", "p").first().auroc == brute
    assert [(r.threshold, r.fpr, r.tpr) for r in stats.roc_curve(scored, "s", "p").orderBy("threshold").collect()] == [(0.1, 1.0, 1.0), (0.4, 0.5, 1.0), (0.9, 0.0, 0.5)]


def test_upgma_by_hand(spark):
    matrix = np.array([[0, 2, 6, 12], [2, 0, 8, 14], [6, 8, 0, 16], [12, 14, 16, 0]], float)
    nodes = phylogeny.upgma(matrix)
    assert [n[1] for n in nodes] == [0, 0, 0, 0, 1, 3.5, 7]  # 2 / 2; (6 + 8) / 2 / 2; (12 + 14 + 16) / 3 / 2
    assert [set(n[2:4]) for n in nodes[4:]] == [{0, 1}, {2, 4}, {3, 5}]
    assert phylogeny.upgma(np.zeros((0, 0))) == []
    assert phylogeny.upgma(np.array([[3.0]])) == [(0, 0.0, None, None, 1)]
    rows = [(7, i, j, float(matrix[i, j])) for i in range(4) for j in range(i)]
    got = phylogeny.trees(spark.createDataFrame(rows, "tree int, i long, j long, dist double")).collect()
    assert sorted(r.age for r in got)[-3:] == [1, 3.5, 7]
