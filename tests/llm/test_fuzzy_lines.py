"""Line dedup against plain edit similarity of all pairs of lines."""

from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from loomsketch.llm import fuzzy_lines, queries


#: Lines of fewer characters are compared all with all.
SHORT = 400


def words_of(line: str) -> list[str]:
    return re.findall(r"[^\W_]+", line.lower())


def simhash(words: list[str]) -> int:
    votes = {xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words}
    return sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in votes) > len(votes))


@pytest.fixture(scope="module")
def classes(sf):
    """The first place of each normalised line, by line."""
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    first: dict[str, tuple[int, int]] = {}
    for d, t in sorted(rows):
        for i, line in enumerate(t.split("\n")):
            norm = " ".join(words_of(line))
            if norm:
                first.setdefault(norm, (d, i))
    return rows, first


@pytest.fixture(scope="module")
def similar(classes):
    """All pairs of distinct lines of edit similarity 0.8, by comparing all with all."""
    lines = np.array(sorted(n for n in classes[1] if len(n) < SHORT), object)
    sizes = np.array([len(n) for n in lines])
    x, y = np.triu_indices(len(lines), 1)
    near = 5 * np.abs(sizes[x] - sizes[y]) <= np.maximum(sizes[x], sizes[y])
    pairs = pd.DataFrame({"a": lines[x[near]], "b": lines[y[near]]})
    con = duckdb.connect()
    con.register("pairs", pairs)
    return con.sql("select a, b from pairs where 5 * levenshtein(a, b) <= greatest(length(a), length(b))").fetchall()


def roots(pairs):
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return find


def test_whole_table_against_all_pairs(spark, sf, classes, similar):
    """Nine tenths of the similar pairs end in one group at least, and no group holds lines that similar pairs don't join."""
    rows, first = classes
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    _, found = fuzzy_lines.line_classes(docs)
    place = {(r.doc_id, r.line): r.id for r in found.select("first.*", "id").collect()}
    assert len(place) == len(first)
    ids = {line: place[at] for line, at in first.items()}
    groups = {r.node: r.component for r in fuzzy_lines.linked(docs, found, 0.8)[0].collect()}
    met = sum(groups.get(ids[a], ids[a]) == groups.get(ids[b], ids[b]) for a, b in similar)
    assert len(similar) >= 25 and met >= 0.9 * len(similar)
    truth, lines = roots((ids[a], ids[b]) for a, b in similar), {i: line for line, i in ids.items()}
    long = {i for i in groups if len(lines[i]) >= SHORT}
    assert all(i in long or c in long or truth(i) == truth(c) for i, c in groups.items())


def test_what_goes_follows_from_the_groups(spark, sf, classes):
    """Of all lines of a group the first occurrence stays, and of a class without a group too."""
    rows, first = classes
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    _, found = fuzzy_lines.line_classes(docs)
    place = {r.id: (r.doc_id, r.line) for r in found.select("first.*", "id").collect()}
    ids = {at: i for i, at in place.items()}
    groups = {r.node: r.component for r in fuzzy_lines.linked(docs, found, 0.8)[0].collect()}
    stays: dict[int, tuple[int, int]] = {}
    for i, c in groups.items():
        stays[c] = min(stays.get(c, place[i]), place[i])
    expected = {}
    for d, t in rows:
        kept = []
        for i, line in enumerate(t.split("\n")):
            norm = " ".join(words_of(line))
            at = first.get(norm)
            if not norm or (d, i) == stays.get(groups.get(ids[at]), at):
                kept.append(line)
        expected[d] = kept
    result = {r.doc_id: r for r in queries.op1_fuzzy_lines(spark, sf).collect()}
    assert len(result) == len(rows)
    for d, t in rows:
        assert result[d].n_lines == len(t.split("\n"))
        assert result[d].n_removed == len(t.split("\n")) - len(expected[d])
        assert result[d].kept_sha256 == hashlib.sha256("\n".join(expected[d]).encode()).hexdigest()


def test_simhash(spark):
    words = ["a", "quick", "brown", "fox", "fox"]
    row = spark.range(1).select(fuzzy_lines.simhash(F.array(*map(F.lit, words))).alias("s")).first()
    assert row.s & (2**64 - 1) == simhash(words)


def test_lines_with_fewer_changed_words_than_blocks_share_one(spark):
    """However the words are chosen: an edit of w words touches 2 w blocks at most, and what fills the blocks before them."""
    base = [f"word{i}" for i in range(60)]
    rows = [(0, base)] + [(k, base[:k] + ["other"] + base[k + 1 :]) for k in range(1, 60)]
    keyed = fuzzy_lines.with_keys(spark.createDataFrame(rows, "id long, words array<string>")).collect()
    keys = {r.id: set(r["keys"]) - {None} for r in keyed}
    assert all(keys[0] & keys[k] for k in range(1, 60)) and len(keys[0]) <= 10
    few = [(0, ["a"]), (1, ["a", "a"]), (2, ["a", "b"])]
    keys = {r.id: set(r["keys"]) - {None} for r in fuzzy_lines.with_keys(spark.createDataFrame(few, "id long, words array<string>")).collect()}
    assert keys[0] == keys[1] and len(keys[0]) == 1 and not keys[0] & keys[2]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(2000))
    rows = [
        (None, "Same line here, of some length", "x"),
        (1, "same LINE here of some length\n\n--\nother words that stand alone", "x"),
        (2, None, None),
        (3, "", "x"),
        (4, long, "x"),
        (5, long + " more", "x"),
        (6, "alpha beta gamma\nalpha beta gamma", "x"),
        (6, "alpha beta gamma\nalpha beta gamma", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, a string")


def test_nulls_repeats_and_clashing_columns(spark, odd):
    docs = odd.withColumn("line", F.lit(1)).withColumn("key", F.lit(2)).withColumn("gone", F.lit(3))
    out = fuzzy_lines.deduplicated(docs)
    assert out.columns[:6] == ["doc_id", "text", "a", "line", "key", "gone"]
    found = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
    texts = {f[0]: f for f in found}
    assert texts[0][3] == 0
    assert texts[1][1:] == ("\n--\nother words that stand alone", 4, 1)
    assert texts[2][1:] == (None, 0, 0)
    assert texts[3][1:] == ("", 1, 0)
    assert texts[5][1:] == ("", 1, 1)
    assert [f[1:] for f in found if f[0] == 6] == [("alpha beta gamma", 2, 1)] * 2


def test_empty(spark, odd):
    assert fuzzy_lines.deduplicated(odd.limit(0)).count() == 0


def test_lines_of_any_length_have_a_simhash(spark, monkeypatch):
    words = [f"w{i}" for i in range(fuzzy_lines.LONGEST + 5_000)]
    row = spark.createDataFrame([(words,)], "words array<string>").select(fuzzy_lines.simhash(F.col("words")).alias("s")).first()
    assert row.s & (2**64 - 1) == simhash(words)
    monkeypatch.setattr(fuzzy_lines, "FEW", 50)
    monkeypatch.setattr(fuzzy_lines, "LONGEST", 100)
    line = " ".join(words[:500])
    docs = spark.createDataFrame([(1, line), (2, line + " more")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in fuzzy_lines.deduplicated(docs).collect()} == {1: 0, 2: 1}
