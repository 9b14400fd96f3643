"""Synthetic sequences in groups of relatives, for experiments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SHAPES = ("path", "pair", "star", "tree")
#: Codes that leave a task together, about: a batch for each group takes longer than its sequences.
TOGETHER = 1 << 18


def mutated(seq: np.ndarray, rate: float, size: int, rng: np.random.Generator) -> np.ndarray:
    """Each place is kept, or with a third of the rate each, a code is inserted before it, it goes, or it becomes another."""
    fate = rng.random(len(seq))
    other = (seq + rng.integers(1, max(2, size), len(seq))) % size
    fresh = rng.integers(0, size, len(seq))
    insert, delete, change = fate < rate / 3, (fate >= rate / 3) & (fate < 2 * rate / 3), (fate >= 2 * rate / 3) & (fate < rate)
    own = np.where(change, other, seq)
    pairs = np.stack([fresh, own], 1)
    keep = np.stack([insert, ~delete], 1)
    return pairs[keep]


def fixed_length(seq: np.ndarray, length: int, size: int, rng: np.random.Generator) -> np.ndarray:
    """Cut, or filled up with random codes."""
    return np.concatenate([seq[:length], rng.integers(0, size, max(0, length - len(seq)))])


def group(shape: str, members: int, length: int, size: int, rates: tuple[float, float], fix: bool, rng: np.random.Generator, founder: np.ndarray | None = None) -> list[np.ndarray]:
    """A founder, random if none is given, and relatives of it."""

    def child(of: np.ndarray) -> np.ndarray:
        new = mutated(of, rng.uniform(*rates), size, rng)
        return fixed_length(new, length, size, rng) if fix else new

    found = [rng.integers(0, size, length) if founder is None else fixed_length(founder, length, size, rng) if fix else founder]
    while len(found) < members:
        if shape in ("path", "pair"):
            found.append(child(found[-1]))
        elif shape == "star":
            found.append(child(found[0]))
        else:
            found += [child(s) for s in found]
    return found[:members]


def sequences(spark: SparkSession, *, num_seqs: int = 200, seq_len: int = 256, size: int = 4, group_size: int = 2, shape: str = "path", rates: tuple[float, float] = (0.0, 0.5), fix_len: bool = False, seed: int = 20251) -> DataFrame:
    """(seq_id, group, seq); a group's sequences depend on nothing but seed and the group's number."""
    if shape not in SHAPES:
        raise ValueError(f"unknown shape {shape!r}; known are {', '.join(SHAPES)}")
    members = 2 if shape == "pair" else group_size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch["id"]:
                made = group(shape, members, seq_len, size, rates, fix_len, np.random.default_rng([seed, int(g)]))
                ids = [int(g) * members + i for i in range(members)]
                yield pd.DataFrame({"seq_id": ids, "group": int(g), "seq": made})[lambda d: d["seq_id"] < num_seqs]

    return spark.range(-(-num_seqs // members)).mapInPandas(run, "seq_id long, group long, seq array<int>")


def relatives(founders: DataFrame, *, size: int, members: int = 2, shape: str = "path", rates: tuple[float, float] = (0.0, 0.5), length: int | None = None, seed: int = 20251) -> DataFrame:
    """(seq_id, group, seq): groups that founders(seq_id, seq) found, seq_id as group; sequences of one length, if it is given. A group depends on nothing but
    seed, its founder and its number. Null sequences and ids found none; codes outside the alphabet are left out."""
    if shape not in SHAPES:
        raise ValueError(f"unknown shape {shape!r}; known are {', '.join(SHAPES)}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, groups, found, many = [], [], [], 0
            for g, seq in zip(batch["seq_id"], batch["seq"], strict=True):
                codes = np.asarray(seq, np.int64)
                codes = codes[(codes >= 0) & (codes < size)]
                found += group(shape, members, length or len(codes), size, rates, length is not None, np.random.default_rng([seed, int(g) % (1 << 63)]), codes)
                ids += [int(g) * members + i for i in range(members)]
                groups += [int(g)] * members
                many += sum(map(len, found[-members:]))
                if many > TOGETHER:
                    yield pd.DataFrame({"seq_id": ids, "group": groups, "seq": found})
                    ids, groups, found, many = [], [], [], 0
            if ids:
                yield pd.DataFrame({"seq_id": ids, "group": groups, "seq": found})

    return founders.where("seq_id IS NOT NULL AND seq IS NOT NULL").select(founders.seq_id.cast("long").alias("seq_id"), "seq").mapInPandas(run, "seq_id long, group long, seq array<int>")
