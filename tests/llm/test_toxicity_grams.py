"""Grams by running sums against plain sets, counterfactuals by language, and what the penalty does to the given labels."""

from __future__ import annotations

import re

import numpy as np

from loomsketch.llm import toxicity

LETTERS = re.compile(r"[^\W\d_]+")


def plain(text):
    out = set()
    for w in LETTERS.findall(text.lower()):
        out.add("=" + w)
        out |= {w[i : i + n] for n in (4, 5, 6, 7) for i in range(len(w) - n + 1)}
    return out


def buckets(text):
    return set(toxicity.gram_buckets([text])[1].tolist())


TEXTS = ["", "One two THREE three", "a_b 12 c3d straße ΣΊΣΥΦΟΣ", "été\tété\n\nÉTÉ", "中文字符字符 naïve", "x" * 50, "abcdefgh abcdefg", None]


def test_as_many_grams_as_plain_sets_have():
    text, bucket = toxicity.gram_buckets(TEXTS)
    for i, t in enumerate(TEXTS):
        mine = set(bucket[text == i].tolist())
        assert len(mine) == len(plain(t or "")) and mine == buckets(t or "")
        assert mine == set().union(*(buckets(w) for w in LETTERS.findall(t or "")), set())
    assert buckets("abcd") != buckets("dcba") and len(buckets("abcd") & buckets("xabcdx")) == 1  # the run, not the word


def test_long_texts_are_taken_in_parts(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 12))) for _ in range(n)) for n in (3, 400, 0, 50)]
    whole = toxicity.gram_buckets(texts)
    monkeypatch.setattr(toxicity, "PART", 64)
    parts = toxicity.gram_buckets(texts)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    used = np.zeros(toxicity.BUCKETS, bool)
    used[whole[1][::7]] = True
    some = toxicity.gram_buckets(texts, used)
    assert set(zip(*map(list, some), strict=True)) == {(t, b) for t, b in zip(*map(list, whole), strict=True) if used[b]}


def test_counterfactuals_keep_to_the_language():
    assert toxicity.language("The man is in the house") == "en" and toxicity.language("Der Mann ist nicht da") == "de" and toxicity.language("xyz") is None
    # "jungen" is a German name in an English sentence: a word like others
    assert toxicity.counterfactuals("The jungen of the town. Die jungen und die alten.") == [(" Die jungen und die alten", " Die mädchen und die alten")]
    put = toxicity.insertions("The house is on the hill. Das Haus ist auf dem Berg. women are in the hall. qqq")
    assert [s for s, _, _ in put] == ["The house is on the hill", " Das Haus ist auf dem Berg"]
    kinds = [toxicity.kinds_of("en"), toxicity.kinds_of("de")]
    for (_, x, y), of in zip(put, kinds, strict=True):
        assert x != y and any(x in kind and y in kind for kind in of)


def test_penalty_acts_on_names_that_are_put_in(spark):
    """Toxic sentences have words that share letters with names, though no sentence names a group: without the penalty their scores follow those letters."""
    rng = np.random.default_rng(3)
    vile, calm = ["muslimrot", "womenstink", "jewishlie", "arabgrovel"], ["meeting", "garden", "singing", "cooking"]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        texts.append(f"The {rng.choice(vile if toxic else calm)} is in the town{i % 17} and it was for the day")
        labels.append(int(toxic))
    fair, plain_model = toxicity.fit(texts, labels), toxicity.fit(texts, labels, fair=0.0)
    gap = lambda m: np.mean([abs(m.scorer()(f"The {a} came") - m.scorer()(f"The {toxicity.SWAPS[a]} came")) for a in ("muslim", "women", "jewish", "arab")])
    assert gap(fair) < 0.6 * gap(plain_model)
    assert np.mean([(fair.scorer()(t) >= 0.5) == y for t, y in zip(texts, labels, strict=True)]) > 0.98


def test_penalty_on_the_given_labels(spark):
    """The fit over a table is that over its texts, and with the penalty names change the log-odds no more than without."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fair, none = toxicity.train(docs, labels), toxicity.train(docs, labels, fair=0.0)
    known = {r.doc_id: r.toxic for r in labels.where(~toxicity.held_out(labels.doc_id)).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect() if known.get(r.doc_id) in (0, 1))
    here = toxicity.fit([t for _, t in rows], [known[d] for d, _ in rows])
    assert set(here.weights) == set(fair.weights) and all(abs(here.weights[g] - w) < 1e-6 for g, w in fair.weights.items())

    def change(m):
        z = lambda t: float(np.log(m.scorer()(t) / (1 - m.scorer()(t))))
        return sum((z(a) - z(b)) ** 2 for a, b in toxicity.SWAPS.items())

    assert change(fair) <= change(none) + 1e-9
    print("squared change over all names", change(fair), change(none))
