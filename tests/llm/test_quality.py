"""The quality classifier."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest

from loomsketch.llm import quality, queries


def held(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_descent_finds_the_least_loss():
    """No small step from the weights lowers the loss."""
    rng = np.random.default_rng(1)
    x = rng.random((60, 5)) * (rng.random((60, 5)) < 0.7)
    y = np.sign(x @ [1, -2, 1, 0, 0.5] - 0.2 + 0.2 * rng.standard_normal(60))
    cost = np.where(y > 0, 1.0, 2.0)
    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x]
    w, bias = quality.descend(rows, y, cost, 5, passes=4000, until=1e-9)
    at = np.append(w, bias)
    full = np.append(x, np.ones((60, 1)), 1)
    loss = lambda v: v @ v / 2 + cost @ np.maximum(0, 1 - y * (full @ v))
    best = loss(at)
    assert all(loss(at + step * rng.standard_normal(6)) >= best - 1e-3 for step in (0.3, 0.03, 0.003) for _ in range(300))


def test_grams_are_those_of_each_text_by_itself():
    texts = [b"One two ONE", b"", b"x***  2024 Caf\xc3\xa9!!", b"\t \n", b"one Two one"]
    together = quality.grams(texts, np.ones(quality.BUCKETS, bool))
    for i, t in enumerate(texts):
        alone = quality.grams([t], np.ones(quality.BUCKETS, bool))[1]
        assert together[1][together[0] == i].tolist() == alone.tolist()
    sizes = [int((together[0] == i).sum()) for i in range(5)]
    # lower-case words and pairs (2 + 2), shapes by one, two and three (3 + 2 + 1)
    assert sizes[0] == 10 and sizes[1] == sizes[3] == 0 and sizes[2] == 3 + 2 + 3 + 2 + 1
    used = np.zeros(quality.BUCKETS, bool)
    used[together[1][:3]] = True
    assert set(quality.grams(texts, used)[1]) == set(together[1][:3])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_quality_held_out(spark, sf):
    rows = {r.doc_id: r for r in queries.op11_quality(spark, sf).collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == held(d) for d, r in rows.items())
    labels = dict(duckdb.execute(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    of = [(labels[d], r.score) for d, r in rows.items() if d in labels and r.held_out]
    wins = [(p > q) + 0.5 * (p == q) for y, p in of if y for z, q in of if not z]
    assert np.mean(wins) > 0.97
    assert np.mean([p >= 0.3 for y, p in of if y]) > 0.97 and np.mean([p >= 0.3 for y, p in of if not y]) < 0.2
    again = {r.doc_id: r.score for r in queries.op11_quality(spark, sf).collect()}
    assert again == {d: r.score for d, r in rows.items()}


def test_counts_are_of_all_labelled_rows(spark):
    texts = ["a b", "a", "b", "a b", None, ""]
    table = spark.createDataFrame([(t or "", i % 2) for i, t in enumerate(texts)], "text string, label int").repartition(3)
    counts = {r.bucket: (r.n0, r.n1) for r in quality.counted(table).collect()}
    assert counts.pop(-1) == (3, 3)
    of = {}
    for i, t in enumerate(texts):
        for b in quality.grams([(t or "").encode()], np.ones(quality.BUCKETS, bool))[1]:
            of.setdefault(int(b), [0, 0])[i % 2] += 1
    assert counts == {b: tuple(n) for b, n in of.items()}


def test_names_and_ids_are_no_input(spark):
    """The same texts under other ids of the same fold, languages and sources have the same scores."""
    texts = [("good words in a row, and more of them." if i % 3 else "BAD!! WORDS!! ***") + f" n{i % 7}" for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    by_text = {}
    for i, t in enumerate(texts):
        by_text.setdefault(t, set()).add(scores[i])
    assert all(len(s) == 1 for s in by_text.values())
    assert all((scores[i] >= 0.3) == (i % 3 > 0) for i in range(90))


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (99, 1), (None, 1), (7, 0), (8, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (3, 4)} == {quality.Model(model.bias, model.slope, model.offset).scorer()([""])[0]}
    assert len({r.score for r in rows if r.doc_id == 8}) == 1
    assert quality.score(nothing, model).count() == 0
    none = quality.train(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, none).collect()} == {quality.Model().scorer()([""])[0]}
    assert all(r.predicted == 1 for r in quality.score(odd, quality.train(odd, labels.where("quality = 1"))).collect())
    assert quality.train(nothing, labels).features == {}
