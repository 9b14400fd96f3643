"""Sketches merged from parts, against the sketch of the whole."""

from __future__ import annotations

import numpy as np
import pytest

from loomsketch.functions import hashing
from loomsketch.operators import merging, tensors


@pytest.mark.parametrize("t", [1, 2, 3, 4])
def test_parts_of_any_cut_give_the_whole(spark, t):
    tables = hashing.TensorTables.drawn(4, t, 7, t)
    rng = np.random.default_rng(t)
    rows, expected = [], {}
    for i, n in enumerate((0, 1, t, 23, 200)):
        seq = rng.integers(0, 4, n)
        expected[i] = (n, tensors.sketch_batch([seq], tables)[0])
        cuts = sorted(rng.integers(0, n + 1, 9))
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, n], strict=True)):
            rows.append((i, 100 + 3 * part, [int(c) for c in seq[a:b]] + ([-1, 9] if part % 2 else [])))
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "seq_id long, part int, seq array<int>").repartition(3)
    found = {r.seq_id: (r.n, r.sketch) for r in merging.merged_sketches(df, tables, fan=2).collect()}
    assert set(found) == set(expected)
    for i, (n, sketch) in expected.items():
        assert found[i][0] == n and np.allclose(found[i][1], sketch, atol=1e-12)


def test_merge_is_associative():
    tables = hashing.TensorTables.drawn(3, 3, 5, 1)
    a, b, c = merging.states([np.random.default_rng(i).integers(0, 3, 4 + i) for i in range(3)], tables)
    left = merging.joined(merging.joined(a, b, 3), c, 3)
    right = merging.joined(a, merging.joined(b, c, 3), 3)
    assert left[0] == right[0] and np.allclose(left[1], right[1], atol=1e-14)


def test_odd_parts(spark):
    tables = hashing.TensorTables.drawn(4, 2, 4, 1)
    df = spark.createDataFrame([(None, 1, [1]), (1, None, [1]), (2, 1, None), (3, 5, []), (3, 6, [None, 2])], "seq_id long, part int, seq array<int>")
    assert [(r.seq_id, r.n, r.sketch) for r in merging.merged_sketches(df, tables).collect()] == [(3, 1, [0.0] * 4)]
    assert merging.merged_sketches(df.limit(0), tables).collect() == []
