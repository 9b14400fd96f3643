"""Substring dedup, near dedup, fingerprints, line and vector groups, against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsketch.llm import common, fingerprints, forest, queries, substrings, tiles, words


@pytest.fixture(scope="module")
def texts(sf):
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()


def without_repeats(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = t.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            run = tuple(w[i : i + 20])
            if run in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(run)
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("widest", [substrings.WIDEST, 1 << 12])
def test_substrings_of_a_whole_table(spark, sf, texts, widest, monkeypatch):
    monkeypatch.setattr(substrings, "HELD", 20_000)
    expected = without_repeats(texts)
    rows = substrings.deduplicated(common.documents(spark, sf).repartition(5), widest).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text.encode()) for r in rows} == expected


def test_substrings_query(spark, sf, texts):
    expected = {d: (n, g, hashlib.sha256(x).hexdigest()) for d, (n, g, x) in without_repeats(texts).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_substrings(spark, sf).collect()} == expected


def test_substrings_of_odd_rows(spark, odd, nothing):
    rows = substrings.deduplicated(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count()
    assert (got[3].n_words, got[3].text) == (0, "") and got[6].text == "two spaces"
    assert (got[5].n_words, got[5].n_removed, len(got[5].text.split())) == (30_000, 29_999, 1)
    assert got[None].n_removed == 0
    run = " ".join(f"w{i}" for i in range(25))
    same = spark.createDataFrame([(None, run), (1, run), (1, run), (1, run + " x"), (2, run), (3, run.replace(" ", "\n"))], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.deduplicated(same).collect()) == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 25), (3, 25)]
    assert substrings.deduplicated(nothing).count() == 0


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_groups(rows, n, percent):
    sets = {d: shingle_set(t, n) for d, t in rows}
    at, common_ = defaultdict(list), Counter()
    for d in sorted(sets):
        for s in sets[d]:
            common_.update((d, other) for other in at[s])
            at[s].append(d)
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for (a, b), c in common_.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_forest_of_a_whole_table(spark, sf, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op9_forest(spark, sf).collect()}
    assert got == near_groups(texts, 4, 80)


@pytest.mark.parametrize("block", [512, 16])
@pytest.mark.parametrize("most", [9, 16])
def test_forest_keeps_links_in_large_groups(spark, monkeypatch, block, most):
    """Copies with up to most changed words of 200: with many, some are linked with none or few of the others."""
    monkeypatch.setattr(forest, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(150):
        w = list(base)
        for i in rng.integers(0, 200, rng.integers(0, most)):
            w[i] = f"x{rng.integers(0, 10_000)}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in forest.grouped_documents(docs).collect()}
    assert got == near_groups(rows, 4, 80)


@pytest.mark.parametrize("hubs", [1, 10_000])
def test_cells_bring_strays_to_all_rows_of_their_region(spark, monkeypatch, hubs):
    monkeypatch.setattr(forest, "BLOCK", 4)
    rows = [(r, i, i % 5 if i % 5 < 3 else 3) for r in (1, 2) for i in range(r * 100, r * 100 + 30)] + [(3, i, 7) for i in range(9)]
    monkeypatch.setattr(common, "HUBS", hubs)
    cells = forest.dealt(spark.createDataFrame(rows, "region long, id long, of long"), len(rows)).toPandas()
    assert set(cells.region) == {1, 2}
    met = Counter()
    for (region, _, _), cell in cells.groupby(["region", "p", "q"]):
        met.update((region, a, b) for a in cell.id[cell.left] for b in cell.id[cell.right])
    assert met == {(r, a, b): 1 for r, a, of in rows if r < 3 and of != 3 for s, b, _ in rows if s == r}


def test_forest_of_odd_rows(odd, nothing):
    rows = forest.grouped_documents(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count()
    assert (got[2].component_id, got[2].kept, got[1].kept) == (1, False, True)
    assert (got[3].n_shingles, got[3].component_id, got[4].component_id) == (0, 3, 4)
    assert (got[None].component_id, got[None].kept) == (None, True)
    assert got[5].n_shingles == 1 and [r.component_id for r in rows if r.doc_id == 8] == [8, 8]
    assert forest.grouped_documents(nothing).count() == 0


def fives(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints_of_a_whole_table(spark, sf, texts):
    by_id = dict(texts)
    order = sorted(by_id, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    rows = queries.op8_fingerprints(spark, sf).collect()
    assert len(rows) == len(by_id)
    prints = {}
    for r in rows:
        t, nxt = by_id[r.doc_id], by_id[after[r.doc_id]]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = fives(t), fives(edited), fives(nxt)
        small = len(a | b) <= fingerprints.K
        assert abs(r.near_edited - len(a & b) / len(a | b)) <= (1e-9 if small else 0.25)
        assert abs(r.near_next - len(a & c) / len(a | c)) <= 0.25
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_of_odd_rows(odd, nothing):
    rows = fingerprints.compared(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: r for r in rows}
    assert got[3].sketch.hashes == [] and got[5].n_chars == 150_000 and len(got[5].sketch.hashes) == 1
    assert got[1].sketch == got[2].sketch
    assert fingerprints.compared(nothing).count() == 0
    single = odd.where("doc_id = 1")
    assert fingerprints.compared(single).first().next_sketch == got[1].sketch


def test_sketches_merge(spark, sf):
    docs = common.documents(spark, sf).select("doc_id", "source", "text")
    parts = fingerprints.fingerprint(docs, 64)
    whole = docs.select("source", F.explode(fingerprints.shingle_hashes(F.col("text"))).alias("h")).distinct().groupBy("source").agg(F.slice(F.sort_array(F.collect_list("h")), 1, 64).alias("hashes"), F.count("*").alias("n"))
    merged = {r.source: r for r in fingerprints.merged(parts, "source", k=64).withColumn("n", fingerprints.distinct_count(F.col("sketch"))).collect()}
    for r in whole.collect():
        assert merged[r.source].sketch.hashes == r.hashes
        assert abs(merged[r.source].n / r.n - 1) < 0.6
    a, b = (F.struct(F.array(*map(F.lit, v)).cast("array<bigint>").alias("hashes"), F.lit(False).alias("full")) for v in ((1, 2, 3), (2, 3, 4, 5)))
    values = spark.range(1).select(fingerprints.resemblance(a, b), fingerprints.containment(a, b), fingerprints.merge(a, b).hashes).first()
    assert values[0] == pytest.approx(2 / 5) and values[1] == pytest.approx(2 / 3) and values[2] == [1, 2, 3, 4, 5]


def vector_groups(rows, threshold=0.9):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    names = np.array([i for i, _ in rows])
    while True:
        new = np.minimum(names, np.where(linked, names[None], 1 << 60).min(1))
        if (new == names).all():
            return {i: (int(linked[k].sum()), int(names[k]), bool(names[k] == i)) for k, (i, _) in enumerate(rows)}
        names = new


def test_vectors_in_groups(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] * 10 + rng.normal(size=16) * rng.uniform(0, 6)).astype("f4").tolist()) for i in range(600)]
    rows += [(600 + i, rows[i][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in tiles.grouped_vectors(df, tile=100).collect()}
    assert got == vector_groups(rows)


def test_tiles_that_meet():
    bounds = np.sort(np.random.default_rng(1).normal(0, 0.4, 5_000).clip(-1, 1))
    first, last = tiles.reaches(bounds, 0.9)
    edges, reach = np.arccos(np.concatenate([[-1.0], bounds, [1.0]])), np.arccos(0.9) + 1e-6
    for i in (0, 17, 2_500, 4_999, 5_000):
        meets = np.flatnonzero(edges[i + 1] - edges[i:-1] <= reach) + i
        assert (meets[0], meets[-1]) == (i, last[i])
        met = np.flatnonzero(edges[1 : i + 2] - edges[i] <= reach)
        assert (met[0], met[-1]) == (first[i], i)


def test_vectors_of_a_whole_table(spark, sf):
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op4_tiles(spark, sf).collect()} == vector_groups(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (11, [3.0]), (None, [1.0, 0.0]), (10, [1e-30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(None).cast("int")).withColumn("id", F.lit(1))
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in tiles.grouped_vectors(df).collect()), key=str)
    assert len(got) == len(rows)
    linked = {g for g in got if g[1]}
    assert linked == {(1, 3, 1, True), (2, 3, 1, False), (10, 3, 1, False), (9, 1, 9, True), (11, 1, 9, False)}
    assert (0, 0, None, True) in got
    assert tiles.grouped_vectors(df.limit(0)).count() == 0
    assert tiles.grouped_vectors(df.where("vec_id = 4")).collect()[0].kept


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 100), (5, 5), (200, None)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def patterned():
    """Two words of 1,024 letters that polynomials over 2**64 can't tell apart, whatever their odd base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return one, one.translate({97: 98, 98: 97})


def test_patterned_words_are_told_apart(spark):
    one, other = patterned()
    hashes = words.Words([f"{one} {other}".encode()]).hashes()
    assert hashes[0] != hashes[1]
    sequence = np.array([bin(i).count("1") % 2 for i in range(2048)])
    a, b = (words.runs(hashes[s], 2048) for s in (sequence, 1 - sequence))
    assert a[0] != b[0] and (words.runs(hashes[sequence], 20) == [words.runs(hashes[sequence[i : i + 20]], 20)[0] for i in range(2029)]).all()
    tail = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{other} {tail}")], "doc_id long, text string")
    assert [r.n_removed for r in substrings.deduplicated(docs).collect()] == [0, 0]
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert {r.component_id for r in forest.grouped_documents(docs).collect()} == {1, 2}


def test_words_split_like_bytes():
    rows = [b"", b" a\tb\x0bc\x1cd ", "é x".encode(), b"one"]
    w = words.Words(rows)
    found = [[w.data[w.starts[i] : w.ends[i]] for i in range(a, b)] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    assert found == [r.split() for r in rows]
    assert len(set(w.hashes().tolist())) == 6 and list(words.grouped([b"x" * 10] * 5, 25)) == [(0, 2), (2, 4), (4, 5)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_their_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    found = queries.QUERIES[name](spark, sf)
    expected = con.sql(queries.ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert sorted(map(tuple, found.select(expected.columns).collect())) == sorted(expected.fetchall())
