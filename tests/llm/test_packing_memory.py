"""What a worker that packs holds: a pool's ids once, and no more words than it may remember."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark
from tokenizers import Tokenizer

from loomsketch.llm import packing, tokenise
from test_tokens import WORDS


class Docs:
    """Gives the function that a task runs over batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_ids_of_a_pool_are_held_once(monkeypatch):
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3))
    monkeypatch.setattr(packing, "encoder", lambda *a: lambda texts: (np.arange(100_000, dtype="<u4") for _ in texts))
    run = packing.pack(Docs(), WORDS)
    docs, whole = 80, 80 * 100_001 * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(docs)), pa.array(["x"] * docs)], names=["doc_id", "text"])
    tracemalloc.start()
    ids = sum(sum(some.column("length").to_pylist()) for some in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 4 * ids == whole and peak < 1.5 * whole


def test_an_encoder_remembers_as_many_words_as_it_is_told():
    own = tokenise.Encoder(WORDS, 100)
    text = "x " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    expected = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    for _ in range(3):
        assert own([text])[0].tolist() == expected
        own.pieces.thin()
        own.runs.thin()
        assert len(own.pieces.at) <= 100 and len(own.runs.at) <= 100
    assert tokenise.encoder(WORDS, packing.REMEMBERED).pieces.most == packing.REMEMBERED < tokenise.REMEMBERED
