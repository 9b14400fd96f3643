"""New pieces that go through the byte-level tokenizer many to a text."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomsketch.llm import tokenise

WORDS = [
    "a", "word", "Über", "naïve,", "'s", "it's", "'", "12", "x1y", "$$$", "one.\nTwo", "one\n\n\ntwo", "a\tb", "<|endoftext|>", "x<|endoftext|>y", "Ġ", "Ġaa", "ĠĠ",
    "中文字", "é", " x", "x y", "　", "", "\n", "\nx", "x\n", "🙂🙂", "\x1cq", "q\x00r", "\x85", "é", "w" * 200,
]


def test_pieces_are_the_tokenizers_own():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, own = Tokenizer.from_file(path), tokenise.Encoder(path)
    rng = np.random.default_rng(5)
    texts = [" ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n)) for n in rng.integers(0, 40, 300)]
    texts += [" ".join(f"{w}{n}" for n in range(3 * tokenise.PIECES)) for w in WORDS[:10]]
    for some in (texts, texts[::-1]):  # the second time from what is known
        found = own([t for t in some])
        for t, ids in zip(some, found, strict=True):
            assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert not own.words  # none went to the model by itself


def test_a_vocabulary_that_does_not_tell_goes_piece_by_piece(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, other = tokenise.Encoder(path), tokenise.Encoder(path)
    monkeypatch.setattr(other, "opens", np.zeros_like(other.opens))
    text = " ".join(WORDS)
    assert other([text])[0].tolist() == own([text])[0].tolist() and other.words
