"""MinHash sketches by batches of sequences against those of Columns, the hashes they rest on, and relatives in batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsketch.functions import hashing
from loomsketch.operators import synth
from loomsketch.plans import engine


def test_xxhash_of_arrays_is_that_of_columns(spark):
    keys = [0, 1, 124, -1, 7_999, 2**31, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for seed in (42, -7, 1_043):
        family = hashing.XxHash(3, seed)
        for place in range(3):
            assert [r[0] for r in df.select(family.hash(place, F.col("k"))).collect()] == family.values(place, np.array(keys)).tolist()


@pytest.mark.parametrize("method", ["MH", "WMH", "OMH"])
def test_batched_minhash_is_that_of_columns(spark, method):
    rng = np.random.default_rng(11)
    rows = [[int(x) for x in rng.integers(0, size, n)] for size, n in ((4, 64), (4, 64), (2, 200), (1, 30), (4, 7), (4, 4))]
    rows += [[0, 1, None, 3, 2, 1, 0, 2]] + ([] if method == "OMH" else [[], [1], None])
    df = spark.createDataFrame(list(enumerate(rows)), "seq_id long, seq array<int>").repartition(2)
    common = {"method": method, "size": 4, "kmer_length": 3, "dim": 8, "tuple_length": 2}
    found = []
    for form in ("native", "arrow"):
        sketched = engine.sketched(df, engine.Parameters(form=form, **common)).select("seq_id", "sketch")
        found.append({r.seq_id: r.sketch for r in sketched.collect()})
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_batched_minhash_says_what_is_wrong(spark):
    df = spark.createDataFrame([([1, 1, 1],)], "seq array<int>")
    with pytest.raises(Exception, match="fewer than 4 k-mers"):
        engine.sketched(df, engine.Parameters(method="OMH", tuple_length=4, form="arrow")).collect()
    with pytest.raises(Exception, match="more than 2 times"):
        engine.sketched(df, engine.Parameters(method="WMH", max_len=2, form="arrow")).collect()
    assert len(engine.sketched(df, engine.Parameters(method="WMH", max_len=3, form="arrow")).first().sketch) == 4


def test_relatives_of_long_and_short_founders(spark):
    """More codes than leave a task together."""
    founders = {i: [(i + k) % 4 for k in range(n)] for i, n in enumerate((5, synth.TOGETHER, 0, 3, synth.TOGETHER // 2, 9))}
    df = spark.createDataFrame(list(founders.items()), "seq_id long, seq array<int>").coalesce(1)
    found = {r.seq_id: r for r in synth.relatives(df, size=4, members=3).collect()}
    assert len(found) == 18
    for g, seq in founders.items():
        made = synth.group("path", 3, len(seq), 4, (0.0, 0.5), False, np.random.default_rng([20251, g]), np.array(seq, np.int64))
        assert [(found[3 * g + i].group, found[3 * g + i].seq) for i in range(3)] == [(g, m.tolist()) for m in made]
