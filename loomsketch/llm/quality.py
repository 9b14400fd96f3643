"""A quality classifier: support vectors on indicators scaled by naive Bayes log-count ratios.

A document's features are which grams it holds: words in lower case and pairs of them, and shapes of words (runs of
capitals, of other letters, of digits, and punctuation as it is) by one, two and three. Grams are hashed into BUCKETS.
How many documents of each label hold a bucket is counted over all labelled documents; of the buckets that tell the labels apart
best, at most FEATURES, each indicator is scaled by its log-count ratio, and each document's row to length 1. A linear
machine of hinge loss is fitted to a bounded sample by dual coordinate descent, its weights are drawn towards their mean size,
and margins of rows left out in turn give the sigmoid that makes scores of them.

Nulls: a null text scores like an empty one, which has no gram; null labels, and labels of unknown documents, teach
nothing; a null doc_id counts as held out. Repeated rows are scored each by itself, and counted each; of a document's repeated labels
the largest holds. Without labels of both kinds every score is the share of 1 among them, or 0. Empty tables give empty results.
Whole texts are read, some two million bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .toxicity import held_out
from .words import Words, grouped, runs

#: Labelled documents that the machine is fitted to, about; chosen by a hash of doc_id. Counts are of all.
SAMPLE = 6_000
#: Buckets of grams; how many of them may be features; and in how many labelled documents each must be.
BUCKETS, FEATURES, LEAST = 1 << 18, 4_096, 3
#: What is added to a count, the cost of a unit of loss, and how much of the fitted weights stays.
SMOOTH, COST, OWN = 1.0, 1.0, 0.5
#: Passes of the descent at most, and parts of the sample that are left out in turn.
PASSES, PARTS = 60, 3
#: Scores from here on are predicted 1.
CUT = 0.3

_LOWER, _SHAPE = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97


def grams(texts: list[bytes], used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' grams of used buckets: (number of the text, bucket), each pair once, in order."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    lower, shape = _LOWER[raw], _SHAPE[raw]
    once = np.ones(len(shape), bool)
    once[1:] = (shape[1:] != shape[:-1]) | ((shape[1:] != 65) & (shape[1:] != 97) & (shape[1:] != 48))
    words = Words([lower.tobytes()])
    shapes = Words([shape[once].tobytes()])  # as many: runs are shortened, none goes
    text = np.searchsorted(bounds, words.starts, side="right") - 1
    of, met = [], []
    for kind, (hashes, n) in enumerate([(h, n) for h, longest in ((words.hashes(), 2), (shapes.hashes(), 3)) for n in range(1, longest + 1)]):
        found = runs(hashes, n)
        bucket = ((found + np.uint64(kind)) % np.uint64(BUCKETS)).astype(np.int64)
        stays = used[bucket] & (text[: len(found)] == text[n - 1 :])
        met.append(bucket[stays])
        of.append(text[: len(found)][stays])
    both = np.unique(np.concatenate(of).astype(np.int64) * BUCKETS + np.concatenate(met))
    return both // BUCKETS, both % BUCKETS


def rows_of(texts: list[str | None], used: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of the texts, with their grams of used buckets; all are by default."""
    given = [(t or "").encode("utf-8", "replace") for t in texts]
    used = np.ones(BUCKETS, bool) if used is None else used
    for first, last in grouped(given):
        yield (first, last, *grams(given[first:last], used))


@dataclass
class Model:
    bias: float = 0.0
    #: A score is the sigmoid of slope * margin + offset.
    slope: float = 0.0
    offset: float = -50.0
    #: Of each feature (a bucket): its scale and its weight.
    features: dict[int, tuple[float, float]] = field(default_factory=dict)

    def scorer(self):
        """A function from texts to their scores."""
        scale, weight = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for bucket, (s, w) in self.features.items():
            scale[bucket], weight[bucket] = s, w
        used = scale != 0

        def score(texts: list[str | None]) -> np.ndarray:
            margin = np.full(len(texts), self.bias)
            for first, last, text, bucket in rows_of(texts, used):
                sums = np.bincount(text, scale[bucket] * weight[bucket], last - first)
                sizes = np.sqrt(np.bincount(text, scale[bucket] ** 2, last - first))
                margin[first:last] += np.divide(sums, sizes, out=np.zeros(last - first), where=sizes > 0)
            return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50)))

        return score


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, width: int, passes: int = PASSES, until: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of least 1/2 |w|^2 + sum cost * hinge: each row's dual variable in turn is set where the dual is
    greatest, within 0 and its cost, until none moves by more than a share of it. Rows are (features, values); the bias is the weight of a further feature of value 1."""
    w, bias, alpha = np.zeros(width), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1 for _, v in rows])
    order = np.random.default_rng(3)
    for _ in range(passes):
        most = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            slope = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                most = max(most, abs(step) / cost[i])
                alpha[i] = new
                w[at] += step * y[i] * v
                bias += step * y[i]
        if most < until:
            break
    return w, bias


def _sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid that gives margins their shares of y, by Newton's steps; shares of few are drawn in."""
    n1, n0 = y.sum(), (1 - y).sum()
    aim = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, at = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -50, 50)))
        ridge = np.diag([1e-3, 1e-3])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - aim) + ridge @ (at - [1.0, 0.0]))
        at = at - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fit(rows: list[np.ndarray], labels: list[int], scale: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias, slope and offset from rows of features by their numbers, with each feature's scale."""
    y = np.array(labels, float)
    given = []
    for at in rows:
        v = scale[at]
        given.append((at, v / (np.linalg.norm(v) or 1)))
    share = np.maximum([(1 - y).mean(), y.mean()], 1e-9)
    cost = COST * np.sqrt(0.5 / share)[y.astype(int)]  # the rarer label counts more, half way to even
    sign = 2 * y - 1

    def machine(some: np.ndarray) -> tuple[np.ndarray, float]:
        w, bias = descend([given[i] for i in some], sign[some], cost[some], len(scale))
        return (1 - OWN) * np.abs(w).mean() * np.sign(w) + OWN * w, bias

    part = np.random.default_rng(5).permutation(len(rows)) % PARTS
    margin = np.zeros(len(rows))
    for p in range(PARTS):
        learnt = np.flatnonzero(part != p)
        if len(set(labels[i] for i in learnt)) == 2:
            w, bias = machine(learnt)
            for i in np.flatnonzero(part == p):
                margin[i] = w[given[i][0]] @ given[i][1] + bias
    w, bias = machine(np.arange(len(rows)))
    return (w, bias, *_sigmoid(margin, y))


def counted(texts: DataFrame) -> DataFrame:
    """(bucket, n0, n1): how many rows of texts(text, label) of each label hold each bucket, and, as bucket -1, how many there
    are; partitions send sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), int)
            rows += np.bincount(labels, minlength=2)
            for first, _, text, bucket in rows_of(batch.column(0).to_pylist()):
                for label in (0, 1):
                    total[label] += np.bincount(bucket[labels[first + text] == label], minlength=BUCKETS)
        met = np.flatnonzero(total.sum(0))
        sums = np.concatenate([rows[:, None], total[:, met]], 1)
        yield pa.RecordBatch.from_pydict({"bucket": np.concatenate([[-1], met]).astype(np.int32), "n0": sums[0], "n1": sums[1]})

    parts = texts.select("text", "label").mapInArrow(run, "bucket int, n0 long, n1 long")
    return parts.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> Model:
    """The classifier of docs(doc_id, text) by labels(doc_id, target), held-out documents apart. Counts are of all labelled
    rows; the machine is one task's, over about sample rows of FEATURES numbers at most."""
    of = F.col(target)
    known = labels.where(of.isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(of).cast("int").alias("label"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labelled = texts.join(known.hint("merge"), "doc_id")  # labels grow with the texts: the same join at every size
    counts = written(counted(labelled), "quality-counts")  # BUCKETS + 1 rows at most
    n = counts.where("bucket = -1").select("n0", "n1").first() or (0, 0)
    if not n[0] or not n[1]:
        return Model(offset=50.0 if n[1] else -50.0)
    share = (F.col("n0") + F.col("n1") + 1) / F.lit(n[0] + n[1] + 2.0)
    apart = F.abs(F.col("n1") / float(n[1]) - F.col("n0") / float(n[0])) / F.sqrt(share * (1 - share))
    often = counts.where((F.col("bucket") >= 0) & (F.col("n0") + F.col("n1") >= LEAST))
    best = often.orderBy(apart.desc(), "bucket").limit(FEATURES).collect()
    discard(counts)
    if not best:
        return Model(slope=0.0, offset=float(np.log(n[1] / n[0])))
    buckets = np.array([r.bucket for r in best])
    p, q = (np.array([r[c] for r in best]) + SMOOTH for c in ("n1", "n0"))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[np.abs(ratio) < 1e-12] = 1e-12
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    bound = int(min(1.0, sample / (n[0] + n[1])) * (2**53))
    some = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < bound)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[int]] = []
            for first, last, text, bucket in rows_of(batch.column(1).to_pylist(), place >= 0):
                found += [x.tolist() for x in np.split(place[bucket], np.searchsorted(text, np.arange(1, last - first)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "features", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        w, bias, slope, offset = fit([np.array(r[1], int) for r in rows], [r[2] for r in rows], ratio)
        yield pa.RecordBatch.from_pydict({"weights": [w.tolist()], "bias": [float(bias)], "slope": [slope], "offset": [offset]})

    made = texts.join(some, "doc_id").select("doc_id", "text", "label").mapInArrow(reduce, "doc_id long, features array<int>, label int").repartition(1)
    fitted = made.mapInArrow(run, "weights array<double>, bias double, slope double, offset double").first()
    return Model(fitted.bias, fitted.slope, fitted.offset, {int(b): (float(r), float(w)) for b, r, w in zip(buckets, ratio, fitted.weights, strict=True)})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) to (doc_id, score, predicted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
