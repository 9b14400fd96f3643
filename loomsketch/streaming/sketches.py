"""Sketches of sequences that arrive code by code: tensor embedding states merge by concatenation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def merged(left: list[np.ndarray], right: list[np.ndarray]) -> list[np.ndarray]:
    """Counts of subsequences by length of a concatenation, from those of both parts."""
    return [sum(np.kron(left[q], right[p - q]) for q in range(p + 1)) for p in range(len(left))]


def counted(codes, size: int, t: int) -> list[np.ndarray]:
    state = [np.ones(1), *(np.zeros(size**p) for p in range(1, t + 1))]
    for c in codes:
        if 0 <= c < size:
            for p in range(t, 0, -1):
                state[p].reshape(-1, size)[:, c] += state[p - 1]
    return state


def running_embedding(stream: DataFrame, size: int, t: int) -> DataFrame:
    """(seq_id, n, counts) after each trigger, of a stream (seq_id, at, code); at orders the codes within a trigger."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("at")
        n, flat = state.get if state.exists else (0, [1.0] + [0.0] * sum(size**p for p in range(1, t + 1)))
        cuts = np.cumsum([size**p for p in range(t + 1)])[:-1]
        now = merged(np.split(np.array(flat), cuts), counted(rows["code"], size, t))
        state.update((n + len(rows), np.concatenate(now).tolist()))
        yield pd.DataFrame({"seq_id": [key[0]], "n": [n + len(rows)], "counts": [now[t].tolist()]})

    return stream.groupBy("seq_id").applyInPandasWithState(update, "seq_id long, n long, counts array<double>", "n long, flat array<double>", "update", GroupStateTimeout.NoTimeout)
