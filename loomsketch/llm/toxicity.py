"""A toxicity classifier with a counterfactual penalty.

A document's features are which chosen grams its words hold: whole words, and runs of 4 to 7 letters inside them, hashed into BUCKETS.
The grams are those that best tell the labels of a bounded sample apart, and a logistic regression weighs them. Labelled sentences have
counterfactuals: one that names a group of people, with another group of the same kind in its place; and one that names none, with
either of two groups of a kind put in, in the sentence's language. The loss adds the squared change of the score's log-odds between
the two, so that weight moves from the group's name, and from grams that are in a name by chance, to what is said, and neutral mentions
score like any other text.

Nulls: a null text scores like an empty one; null labels, and labels of unknown documents, teach nothing; a null doc_id
counts as held out. Repeated rows are scored each by itself; of a document's repeated labels the largest holds. Without
labels of both kinds every score is the share of 1 among them, or 0. Empty tables give empty results. Whole texts are read, a part of
some PART letters at a time, so neither long texts nor many words need memory.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .words import mixed

#: Labelled documents that the classifier is fitted on, about; chosen by a hash of doc_id.
SAMPLE = 6_000
#: Grams it may use, and in how many sampled documents each must be.
GRAMS, LEAST = 800, 3
#: Weights of the counterfactual penalty and of the squared weights.
FAIR, RIDGE = 2.0, 1e-4
#: Buckets of grams, and letters of texts that are taken together.
BUCKETS, PART = 1 << 22, 1 << 20

#: Names of groups by kind, in four languages; words that are mostly of another sense are left out; a counterfactual puts the kind's next name in a name's place.
IDENTITIES = (
    # English
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("mothers", "fathers"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("asian", "latino", "arab", "african"),
    ("gay", "lesbian", "bisexual", "heterosexual"),
    ("transgender", "cisgender"),
    ("immigrants", "refugees", "foreigners"),
    ("deaf", "disabled", "elderly"),
    ("mexican", "american", "chinese", "german", "french", "spanish", "indian"),
    # German
    ("frauen", "männer"),
    ("mädchen", "jungen"),
    ("mütter", "väter"),
    ("muslime", "juden", "buddhisten", "atheisten", "katholiken", "protestanten"),
    ("muslimische", "jüdische", "christliche", "buddhistische"),
    ("türken", "polen", "araber", "deutsche", "franzosen", "spanier"),
    ("schwule", "lesben", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    # French
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("filles", "garçons"),
    ("mères", "pères"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulmane", "chrétienne", "juive", "hindoue", "bouddhiste", "athée"),
    ("arabes", "asiatiques", "africains", "allemands", "français", "espagnols"),
    ("homosexuels", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers"),
    # Spanish
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("niñas", "niños"),
    ("madres", "padres"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("musulmana", "cristiana", "judía", "hindú", "budista", "atea"),
    ("árabes", "asiáticos", "africanos", "alemanes", "franceses", "españoles"),
    ("homosexuales", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros"),
)
SWAPS = {name: kind[(i + 1) % len(kind)] for kind in IDENTITIES for i, name in enumerate(kind)}
#: Where each language's kinds begin.
STARTS = {"en": 0, "de": 12, "fr": 20, "es": 29}
# Frequent words by language.
COMMON = {
    "en": frozenset("the of and to in that is was for it with as on are this".split()),
    "de": frozenset("der die das und ist von mit den nicht ein zu sich auf dem als".split()),
    "fr": frozenset("le la les des et est un une du que en dans pour pas sur".split()),
    "es": frozenset("el los las del que y en un una por con para se no su".split()),
}

_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_BREAK = re.compile(r"[\W\d_]")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def kinds_of(language: str) -> tuple:
    starts = [*STARTS.values(), len(IDENTITIES)]
    at = list(STARTS).index(language)
    return IDENTITIES[starts[at] : starts[at + 1]]


_LANGUAGE = {name: language for language in STARTS for kind in kinds_of(language) for name in kind}


def language(sentence: str) -> str | None:
    """The language of most of a sentence's frequent words, if one has the most."""
    words = [w.lower() for w in _LETTERS.findall(sentence)]
    counts = sorted(((sum(w in common for w in words), name) for name, common in COMMON.items()), reverse=True)
    return counts[0][1] if counts[0][0] > counts[1][0] else None


@cache
def _is_letter() -> np.ndarray:
    """Which code points are letters: of words, but neither decimal digits nor underscores."""
    return np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), bool, 0x110000)


def _parts(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts together, and parts of long ones, with their numbers; no word is parted."""
    numbers, some, size = [], [], 0
    for i, text in enumerate(texts):
        text, at = text or "", 0
        while at < len(text):
            stop = len(text)
            if stop - at > PART:
                cut = _BREAK.search(text, at + PART)
                stop = cut.start() if cut else stop
            if size and size + stop - at > PART:
                yield numbers, some
                numbers, some, size = [], [], 0
            numbers.append(i)
            some.append(text[at:stop])
            size += stop - at
            at = stop
    if some:
        yield numbers, some


def gram_buckets(texts: list[str | None], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, bucket) of the texts' grams, of used buckets only if given; each pair once, in order.

    A run of letters has the value of sums of their powers, taken as a difference of running sums: one way for runs of any length.
    """
    found = [np.zeros(0, np.int64)]
    for numbers, some in _parts(texts):
        lower = [t.lower() for t in some]
        points = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
        of = np.repeat(numbers, [len(t) + 1 for t in lower])[: len(points)]
        inside = np.zeros(len(points) + 2, np.int8)
        inside[1:-1] = _is_letter()[points]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(points), b, np.uint64)])) for b in (_BASE, _INVERSE))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        stop = np.repeat(ends, ends - starts)
        place = np.flatnonzero(inside[1:-1])

        def take(first: np.ndarray, last: np.ndarray, salt: int) -> None:
            hashes = mixed((sums[last] - sums[first]) * inverse[first] + np.uint64(salt))
            bucket = (hashes >> np.uint64(42)).astype(np.int64)
            stays = slice(None) if used is None else used[bucket]
            found.append(np.unique(of[first][stays] * BUCKETS + bucket[stays]))

        take(starts, ends, 1)
        for n in (4, 5, 6, 7):
            at = place[stop - place >= n]
            take(at, at + n, n)
    both = np.unique(np.concatenate(found))
    return both // BUCKETS, both % BUCKETS


def counterfactuals(text: str) -> list[tuple[str, str]]:
    """Sentences of a text that name a group, each with the names swapped. A name of another language than the sentence's is a word like others."""
    found = []
    for sentence in _SENTENCE.split(text):
        if not any(w.lower() in SWAPS for w in _LETTERS.findall(sentence)):
            continue
        spoken = language(sentence)
        other = _LETTERS.sub(lambda m: SWAPS.get(m[0].lower(), m[0]) if spoken in (None, _LANGUAGE.get(m[0].lower())) else m[0], sentence)
        if other != sentence:
            found.append((sentence, other))
    return found


def insertions(text: str) -> list[tuple[str, str, str]]:
    """(sentence, name, other name): of each sentence of a known language that names no group, two groups of a kind, by a hash of the sentence."""
    found = []
    for sentence in _SENTENCE.split(text):
        spoken = language(sentence)
        if spoken and not any(w.lower() in SWAPS for w in _LETTERS.findall(sentence)):
            draw = zlib.crc32(sentence.encode("utf-8", "replace"))
            kinds = kinds_of(spoken)
            kind = kinds[draw % len(kinds)]
            found.append((sentence, kind[draw // 64 % len(kind)], kind[(draw // 64 + 1) % len(kind)]))
    return found


@dataclass
class Model:
    bias: float = -50.0
    weights: dict[int, float] = field(default_factory=dict)

    def scores(self):
        """A function from texts to their scores."""
        weight = np.zeros(BUCKETS)
        weight[list(self.weights)] = list(self.weights.values())
        used = weight != 0

        def score(texts: list[str | None]) -> np.ndarray:
            text, bucket = gram_buckets(texts, used)
            z = self.bias + np.bincount(text, weight[bucket], len(texts))
            return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

        return score

    def scorer(self):
        """A function from a text to its score."""
        of = self.scores()
        return lambda text: float(of([text])[0])


class Features:
    """Rows of chosen grams, by their numbers, of texts and of their counterfactuals."""

    def __init__(self, buckets: list[int]):
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[buckets] = np.arange(len(buckets))
        self.used = self.place >= 0
        names = list(SWAPS)
        self.names = dict(zip(names, map(set, self.rows(names)), strict=True))

    def rows(self, texts: list[str | None]) -> list[list[int]]:
        text, bucket = gram_buckets(texts, self.used)
        return [x.tolist() for x in np.split(self.place[bucket], np.searchsorted(text, np.arange(1, len(texts))))] if texts else []

    def changes(self, text: str) -> list[tuple[list[int], list[int]]]:
        """(features that only one side of a counterfactual has, those that only the other has), where there are any."""
        pairs = counterfactuals(text)
        sides = [set(r) for r in self.rows([t for pair in pairs for t in pair])]
        out = [(a - b, b - a) for a, b in zip(sides[::2], sides[1::2], strict=True)]
        put = [(s, x, y) for s, x, y in insertions(text) if self.names[x] != self.names[y]]
        for row, (_, x, y) in zip(map(set, self.rows([s for s, _, _ in put])), put, strict=True):
            out.append((self.names[x] - self.names[y] - row, self.names[y] - self.names[x] - row))
        return [(sorted(a), sorted(b)) for a, b in out if a or b]


def best_grams(seen: np.ndarray, n0: float, n1: float, grams: int) -> list[int]:
    """The buckets that best tell the labels apart, of seen[label, bucket]."""
    share = (seen.sum(0) + 1) / (n1 + n0 + 2)
    apart = np.abs(seen[1] / n1 - seen[0] / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    often = np.flatnonzero(seen.sum(0) >= LEAST)
    return often[np.lexsort((often, -apart[often]))][:grams].tolist()


def solve(rows: list[list[int]], labels: list[int], changes: list[tuple[list[int], list[int]]], buckets: list[int], fair: float = FAIR, ridge: float = RIDGE, steps: int = 300) -> Model:
    """The model of rows of features by their labels, with the penalty on changes."""
    y, width = np.array(labels, float), len(buckets)
    n1, n0 = y.sum(), (1 - y).sum()
    x = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        x[i, row] = 1
    square = np.zeros((width, width))  # of changes: they count by their sum of squares alone
    for a, b in changes:
        both, sign = np.array(a + b), np.array([1.0] * len(a) + [-1.0] * len(b))
        square[np.ix_(both, both)] += np.outer(sign, sign)
    square /= max(1, len(changes))
    rate = np.where(y > 0, np.sqrt(max(1.0, n0 / n1)), 1.0)  # the rarer label counts more, half way to even
    rate /= rate.mean()
    size = rate.max() * (_steepest(x) / len(x) + 1) / 4 + ridge + 2 * fair * (1.01 * float(np.linalg.eigvalsh(square)[-1]) if len(changes) else 0.0)
    w, bias = np.zeros(width), float(np.log(n1 / n0))
    v, c, t = w, bias, 1.0
    for _ in range(steps):  # Nesterov's gradient steps
        off = rate * (1 / (1 + np.exp(-np.clip(x @ v + c, -50, 50))) - y)
        grad = x.T @ off / len(y) + ridge * v + 2 * fair * (square @ v)
        w1, b1, t1 = v - grad / size, c - off.mean() / size, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - bias)
        w, bias, t = w1, b1, t1
    return Model(float(bias), {int(g): float(a) for g, a in zip(buckets, w, strict=True) if abs(a) > 1e-6})


def fit(texts: list[str], labels: list[int], grams: int = GRAMS, fair: float = FAIR, ridge: float = RIDGE, steps: int = 300) -> Model:
    """The classifier of a few labelled texts; train() is that of a table."""
    n1, n0 = float(sum(labels)), float(len(labels) - sum(labels))
    if not n1 or not n0:
        return Model(50.0 if n1 else -50.0)
    seen = np.zeros((2, BUCKETS))
    for label in (0, 1):
        seen[label] = np.bincount(gram_buckets([t for t, y in zip(texts, labels, strict=True) if y == label])[1], minlength=BUCKETS)
    buckets = best_grams(seen, n0, n1, grams)
    features = Features(buckets)
    return solve(features.rows(texts), labels, [c for t in texts for c in features.changes(t)], buckets, fair, ridge, steps)


def _steepest(x: np.ndarray) -> float:
    """The largest eigenvalue of x'x, by powers, and a little more."""
    v = np.ones(x.shape[1])
    for _ in range(30):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1
    return 1.1 * float(np.linalg.norm(x.T @ (x @ v))) + 1e-9


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from the classifier: crc32 of its id's digits is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)) == 0


def counted(texts: DataFrame) -> DataFrame:
    """(bucket, n0, n1): how many rows of texts(text, toxic) of each label hold each bucket, and, as bucket -1, how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), int)
            rows += np.bincount(labels, minlength=2)
            for at in range(0, batch.num_rows, 256):
                text, bucket = gram_buckets(batch.column(0).slice(at, 256).to_pylist())
                for label in (0, 1):
                    np.add.at(total[label], bucket[labels[at + text] == label], 1)
        met = np.flatnonzero(total.any(0))
        sums = np.concatenate([rows[:, None], total[:, met]], 1).astype(np.int64)
        for at in range(0, len(met) + 1, 1 << 16):
            yield pa.RecordBatch.from_pydict({"bucket": np.concatenate([[-1], met])[at : at + (1 << 16)].astype(np.int32), "n0": sums[0, at : at + (1 << 16)], "n1": sums[1, at : at + (1 << 16)]})

    parts = texts.select("text", "toxic").mapInArrow(run, "bucket int, n0 long, n1 long")
    return parts.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fair: float = FAIR) -> Model:
    """The classifier of docs(doc_id, text) by labels(doc_id, toxic), held-out documents apart. Texts of about sample rows become rows of at most GRAMS
    numbers where they are; these rows are one task's."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if not n:
        return Model()
    bound = int(min(1.0, sample / n) * (2**53))
    some = F.broadcast(known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < bound))  # about sample ids
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(some, "doc_id")
    texts = written(texts, "toxicity-sample")
    counts = written(counted(texts), "toxicity-counts")
    of = {r.bucket: (r.n0, r.n1) for r in counts.where("bucket = -1").collect()}
    n0, n1 = (float(x) for x in of.get(-1, (0, 0)))
    if not n0 or not n1:
        return Model(50.0 if n1 else -50.0)
    share = (F.col("n0") + F.col("n1") + 1) / F.lit(n0 + n1 + 2)
    apart = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(share * (1 - share))
    best = counts.where((F.col("bucket") >= 0) & (F.col("n0") + F.col("n1") >= LEAST)).orderBy(apart.desc(), "bucket").limit(GRAMS).collect()  # at most GRAMS rows
    buckets = [r.bucket for r in best]
    if not buckets:
        return Model(float(np.log(n1 / n0)))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch in batches:
            given = batch.column(1).to_pylist()
            changes = [[{"a": a, "b": b} for a, b in features.changes(t)] for t in given]
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features.rows(given), pa.list_(pa.int32())), batch.column(2), pa.array(changes, kind)], names=["doc_id", "features", "toxic", "changes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0], r[1], r[2]))
        model = solve([r[1] for r in rows], [r[2] for r in rows], [(c["a"], c["b"]) for r in rows for c in r[3]], buckets, fair)
        yield pa.RecordBatch.from_pydict({"gram": pa.array([-1, *model.weights], pa.int32()), "weight": [model.bias, *model.weights.values()]})

    made = texts.select("doc_id", "text", "toxic").mapInArrow(reduce, "doc_id long, features array<int>, toxic int, changes array<struct<a: array<int>, b: array<int>>>")
    fitted = made.repartition(1).mapInArrow(run, "gram int, weight double").collect()
    discard(texts)
    discard(counts)
    weights = {r.gram: r.weight for r in fitted}
    return Model(weights.pop(-1, -50.0), weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) to (doc_id, score, predicted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scores()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(of(some.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs(text, ...) that aren't predicted toxic, with their own columns."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scores()
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                some = batch.slice(first, 1024)
                yield some.filter(pa.array(of(some.column(at).to_pylist()) < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
