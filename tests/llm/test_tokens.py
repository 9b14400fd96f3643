"""Token files and packing: exact round trips against the tokenizers themselves."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomsketch.llm import packing, queries, simple8b, token_files, tokenise

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
HARD = ["", " ", "  a  b ", "a\n\n b\t c  ", "<|endoftext|> x <|endoftext|>", "it's  we'll 'tis 's don't can've !foo foo'!", "x" * 300 + " é́ ́a", "a\xa0b \x1c c", "ẞ İ a ab2c µm ªb É.", "　x  y", "é", "foo ́bar"]


def plain(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def texts(sf):
    return dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_tokenizer(path, texts, monkeypatch):
    some = [*texts.values(), *HARD]
    encode = tokenise.Encoder(path)
    expected = plain(path, some)
    for _ in range(2):
        assert [x.tolist() for x in encode(some)] == expected
    monkeypatch.setattr(tokenise, "REMEMBERED", 10)
    assert [x.tolist() for x in encode(some)] == expected
    assert encode([]) == []


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=60, deadline=None)
@given(some=st.lists(st.text(alphabet=" \n\ta'sé.,!1ß́", max_size=30), max_size=5))
def test_encoder_on_any_spaces(path, some):
    assert [x.tolist() for x in tokenise.encoder(path)(some)] == plain(path, some)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_patterned_pieces_are_told_apart(path):
    """Words that polynomials over 2**64 can't tell apart."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate({97: 98, 98: 97})
    texts = [one, other, f"x {one}", f"x {other}"]
    expected = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokenise.Encoder(path)(texts)] == expected


def test_texts_beyond_a_batch(monkeypatch):
    encode = tokenise.Encoder(BYTES)
    monkeypatch.setattr(tokenise, "TOGETHER", 100)
    some = ["short one", "much longer " * 40, "and short"]
    assert [x.tolist() for x in encode(some)] == plain(BYTES, some)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50_000) | st.just(0), max_size=3000))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, firsts, escapes = simple8b.pack(ids)
    assert (simple8b.unpack(words, firsts.astype(np.int64), escapes, len(ids)) == ids).all()


def test_simple8b_packs_words():
    words, _, _ = simple8b.pack(np.zeros(1024, np.uint32))
    assert len(words) == -(-1024 // 240)
    assert len(simple8b.pack(np.full(1024, 20_000, np.uint32))[0]) == 256
    with pytest.raises(ValueError):
        simple8b.read_segment(b"else" + simple8b.write_segment([1], [1], np.array([5], np.uint32))[4:])


def test_token_files_of_a_whole_table(spark, sf, texts):
    rows = {r.doc_id: r for r in queries.op3_token_files(spark, sf).collect()}
    at = 0
    for doc, ids in zip(sorted(texts), plain(BYTES, [texts[d] for d in sorted(texts)]), strict=True):
        data = np.array([*ids, 2], "<u4").tobytes()
        assert (rows[doc].start, rows[doc].n_tokens, rows[doc].ids_crc32) == (at, len(ids) + 1, zlib.crc32(data))
        at += len(ids) + 1


def test_token_files_of_odd_rows(spark, odd, nothing, monkeypatch):
    rows = token_files.read(token_files.write(odd, BYTES)).collect()
    assert len(rows) == odd.count()
    total = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == total
        total += r.n_tokens
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows}
    assert got[3] == got[4] == [2]
    assert got[7] == [*plain(BYTES, ["é́ un texte où l'on compte; 12 mots à peu près, ou plus."])[0], 2]
    assert token_files.read(token_files.write(nothing, BYTES)).count() == 0


def check_pieces(rows, lengths, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == lengths[doc]
            at += r.length
        assert at == lengths[doc]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_sequence)


def test_packing_a_whole_table(spark, sf, texts):
    rows = queries.op6_packing(spark, sf).collect()
    ids = {d: np.array([*x, 2], "<u4") for d, x in zip(texts, plain(WORDS, list(texts.values())), strict=True)}
    sequences = check_pieces(rows, {d: len(x) for d, x in ids.items()}, 4096)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    total = sum(map(len, ids.values()))
    assert sequences <= total / 4096 * 1.03 + 1


def test_packing_odd_rows(spark, odd, nothing):
    rows = packing.pack(odd.where("doc_id <> 8"), WORDS, window=64, pool=500).collect()
    lengths = {r.doc_id: r.doc_tokens for r in rows}
    assert lengths[3] == lengths[4] == 1 and lengths[5] == 30_001
    check_pieces(rows, lengths, 64)
    assert packing.pack(odd.where("doc_id = 8"), WORDS).count() == 2
    assert packing.pack(nothing, WORDS).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit_decreasing_against_a_plain_search(lengths):
    packed = packing.best_fit_decreasing(lengths, 40)
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(40 - n)
    assert sorted(i for w in packed for i in w) == list(range(len(lengths)))
    assert sorted(40 - sum(lengths[i] for i in w) for w in packed) == sorted(rooms)


def _checked(rows, window):
    """Each document's ids in one piece each, sequences without gaps; the share of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_doc.values():
        at = 0
        for start, length, tokens in sorted(pieces):
            assert start == at and 0 < length
            at += length
        assert at == tokens
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    return 1 - sum(r.length for r in rows) / (window * len(by_sequence))


def test_pieces_of_over_half_a_window_are_packed_in_linear_time(spark):
    """Pieces that no two go together of: pools don't fill up with them."""
    import time

    took = {}
    for n in (1500, 6000):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(36)), lambda x: F.lit("a"))).alias("text")).coalesce(1)
        best = []
        for _ in range(2):
            began = time.perf_counter()
            rows = packing.pack(docs, WORDS, window=64, pool=4000).collect()
            best.append(time.perf_counter() - began)
        took[n] = min(best)
        assert _checked(rows, 64) < 0.01 and len({r.doc_id for r in rows}) == n
    assert took[6000] < 8 * took[1500] + 2


def test_many_small_partitions_have_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(50)
    rows = packing.pack(docs, WORDS, window=512).collect()
    assert _checked(rows, 512) < 0.03
