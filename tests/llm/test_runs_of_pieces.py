"""New pieces are put together from runs that are known, and what comes again is kept."""

import itertools

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomsketch.llm import tokenise

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]
PARTS = ["Über", "word", "'", "s", "...", "\n", "\n\n", "×", "÷x", "ÀÞÿß", "_", "7", "<|endoftext|>", "é", "ª"]


@pytest.mark.parametrize("path", PATHS)
def test_runs_are_the_tokenizers_own(path):
    whole, own = Tokenizer.from_file(path), tokenise.Encoder(path)
    some = ["".join(x) for n in (1, 2, 3) for x in itertools.product(PARTS, repeat=n)]
    texts = [*some, "", *(" ".join(some[i : i + 9]) for i in range(0, len(some), 9)), *(f" {t}" for t in some[:200]), ""]
    for _ in range(2):
        for t, ids in zip(texts, own(texts), strict=True):
            assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("path", PATHS)
def test_known_runs_are_not_learnt_again(path, monkeypatch):
    own = tokenise.Encoder(path)
    own(["x alpha, beta gamma...\nGamma"])
    monkeypatch.setattr(own, "_learn_runs", lambda runs: pytest.fail(f"learnt again: {runs}"))
    expected = Tokenizer.from_file(path).encode("x alpha... beta, gamma,\nGamma", add_special_tokens=False).ids
    assert own(["x alpha... beta, gamma,\nGamma"])[0].tolist() == expected


def test_what_came_again_outlives_what_did_not(monkeypatch):
    monkeypatch.setattr(tokenise, "REMEMBERED", 100)
    own = tokenise.Encoder(PATHS[0])
    own(["x often seen"])
    own(["x often seen"])
    own(["x " + " ".join(f"w{i}" for i in range(200))])
    own(["x more"])
    assert {b" often", b" seen", b" more"} <= own.pieces.at.keys() and len(own.pieces.at) < 10
    assert own(["x often seen w7"])[0].tolist() == Tokenizer.from_file(PATHS[0]).encode("x often seen w7", add_special_tokens=False).ids
