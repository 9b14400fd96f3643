"""Files that many tasks read, relatives of given sequences, timing, and experiments over given sequences."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsketch.functions import alphabet, kmers
from loomsketch.operators import synth
from loomsketch.plans import engine, experiment, timing
from loomsketch.sources import fasta, results


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_fasta_in_many_splits(spark, tmp_path, small_splits):
    """Records that lie over splits' edges, a preamble before the first, and a header that begins with >."""
    rng = np.random.default_rng(0)
    expected = {}
    for name, preamble in (("a.fa", "preamble of\nsome lines\n"), ("b.fa", ""), ("c.fa", "")):
        text = preamble
        for i in range(40):
            comment, letters = (">" if i == 7 else "") + f"{name}-{i}", "".join(rng.choice(list("ACGT"), rng.integers(1, 200)))
            expected[name, comment] = letters
            text += f">{comment}\n" + "".join(letters[k : k + 60] + "\n" for k in range(0, len(letters), 60))
        (tmp_path / name).write_text(text)
    read = fasta.read_fasta(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() > 20 or read.select(F.spark_partition_id()).distinct().count() > 1
    rows = read.collect()
    assert {(r.filename, r.comment): r.letters for r in rows} == expected and len(rows) == len(expected)
    order = {}
    for r in sorted(rows, key=lambda r: (r.filename, r.ordinal)):
        order.setdefault(r.filename, []).append(int(r.comment.rsplit("-", 1)[1]))
    assert all(o == list(range(40)) for o in order.values())
    firsts = {r.filename: r.comment for r in fasta.first_per_file(read).collect()}
    assert firsts == {n: f"{n}-0" for n in ("a.fa", "b.fa", "c.fa")}
    coded = fasta.read_fasta(spark, str(tmp_path / "b.fa"), alphabet.DNA4).first()
    assert coded.seq == ["ACGT".index(c) for c in coded.letters]


def test_hex_in_many_splits(spark, tmp_path, small_splits):
    lines = ["" if i % 5 == 4 else ",".join(f"{x:x}" for x in range(i, i + 9)) for i in range(200)]
    (tmp_path / "x.csv").write_text("\n".join(lines))
    (tmp_path / "y.csv").write_text("ff\n")
    rows = fasta.read_hex(spark, str(tmp_path)).collect()
    kept = [x for x in lines if x]
    assert {r.comment: r.seq for r in rows if r.filename == "x.csv"} == {f"seq{i}": [int(x, 16) for x in line.split(",")] for i, line in enumerate(kept)}
    assert [(r.comment, r.seq) for r in rows if r.filename == "y.csv"] == [("seq0", [255])]


def test_triangle_of_many_rows_is_in_order(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("i")).join(spark.range(300).select(F.col("id").alias("j")), F.col("j") < F.col("i"), "left")
    given = rows.select("i", "j", F.when(F.col("j").isNotNull(), F.col("i") * 1000.0 + F.col("j")).alias("dist"), F.concat(F.lit("r"), "i").alias("name"))
    results.write_triangle(given, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*"))).splitlines()
    assert text[0] == "\t300" and [line.split("\t") for line in text[1:]] == [[f"r{i}", *(f"{i * 1000.0 + j}" for j in range(i))] for i in range(300)]


def test_occurrences_of_long_arrays(spark):
    rng = np.random.default_rng(3)
    seqs = [[int(x) for x in rng.integers(0, k, n)] for k, n in ((3, 500), (1, 40), (400, 300), (2, 1), (1, 0))]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i long, s array<bigint>")
    for r in df.select("i", kmers.occurrences(F.col("s")).alias("o")).collect():
        seen, expected = {}, []
        for x in seqs[r.i]:
            expected.append((x, seen.get(x, 0)))
            seen[x] = seen.get(x, 0) + 1
        assert [tuple(o) for o in r.o] == expected


def test_letters_are_looked_up_by_code_point(spark):
    df = spark.createDataFrame([("aCgTé中\x00~",), (None,)], "s string")
    rows = df.select(alphabet.DNA4.encode(F.col("s")).alias("all"), alphabet.DNA4.encode_known(F.col("s")).alias("known"), alphabet.PROTEIN.encode(F.col("s")).alias("p")).collect()
    assert rows[0].all == [0, 1, 2, 3, 5, 5, 5, 5] and rows[0].known == [0, 1, 2, 3] and rows[0].p == [0, 2, 6, 19, 25, 25, 25, 25]
    assert rows[1].all is None and rows[1].known is None


@pytest.mark.parametrize("shape", synth.SHAPES)
def test_relatives(spark, shape):
    df = spark.createDataFrame([(5, [0, 1, 2, 3] * 5), (9, [3, 9, -1, 0]), (6, []), (7, None), (None, [1])], "seq_id long, seq array<int>")
    found = {}
    for r in synth.relatives(df.repartition(3), size=4, members=3, shape=shape, rates=(0.2, 0.2)).collect():
        found.setdefault(r.group, {})[r.seq_id] = r.seq
    assert set(found) == {5, 9, 6} and sorted(found[5]) == [15, 16, 17] and found[5][15] == [0, 1, 2, 3] * 5 and found[9][27] == [3, 0]
    again = {r.seq_id: r.seq for r in synth.relatives(df, size=4, members=3, shape=shape, rates=(0.2, 0.2)).collect()}
    assert again == {i: s for g in found.values() for i, s in g.items()}
    assert {len(r.seq) for r in synth.relatives(df, size=4, shape=shape, length=12).collect()} == {12}


def test_timing_counts_what_went_through(spark):
    rows = synth.relatives(spark.range(6).select(F.col("id").alias("seq_id"), F.transform(F.sequence(F.lit(0), F.lit(30)), lambda x: ((x * (F.col("id") + 3)) % 4).cast("int")).alias("seq")), size=4, members=3)
    methods = [engine.Parameters(method=m, kmer_length=2, dim=4, form="arrow") for m in ("ED", "MH", "TS")]
    table = {r.algo: r for r in timing.relative(timing.measured(rows, methods)).collect()}
    assert set(table) == {"ED", "MH", "TS"}
    for r in table.values():
        assert (r.sketches, r.pairs) == (18, 18) and r.sketch_ms > 0 and r.dist_ms > 0 and r.total_ms == r.sketch_ms + r.dist_ms
    assert table["ED"].relative == 1
    assert {r.relative for r in timing.relative(timing.measured(rows, methods[1:2])).collect()} == {None}


def test_thresholds_by_each_sequences_length(spark):
    """One pair is far by its own length and not by the longest's."""
    rows = spark.createDataFrame([("ED", 0, 0, 1, 6.0), ("ED", 0, 2, 3, 6.0), ("ED", 0, 4, 5, 1.0), ("MH", 0, 0, 1, 9.0), ("MH", 0, 2, 3, 5.0), ("MH", 0, 4, 5, 1.0)], "algo string, rerun int, s1 long, s2 long, dist double")
    lengths = spark.createDataFrame([(0, 10), (2, 100), (4, 10)], "seq_id long, n int")
    r = experiment.quality(rows, [0.5, 0.2], lengths).first()
    assert r.auroc_0_5 == 1.0 and r.auroc_0_2 == 1.0 and r.spearman == pytest.approx(0.866, abs=0.001)
    assert experiment.quality(rows, 0.5, 100).first().auroc is None
