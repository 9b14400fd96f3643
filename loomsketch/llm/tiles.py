"""Near-duplicate vectors by tiled comparison in the order of principal components.

Equal vectors are a class, and one of each class is compared. Vectors are turned into principal components and dealt
into tiles along the first; every pair of tiles is a task's, unless the ranges of their first components already keep
all cosines below the threshold. A task takes its products a square at a time: it adds up leading components first, bounds what the
others can still add by the product of both rests' norms, and goes on only with the pairs whose bound reaches the
threshold. Cosines close to it are taken again from the vectors as they came.

Of a square the task returns no pairs: for each vector, how many it links with, and a name for the part of the square's
link graph that it is in. Those names are the edges of which components are drawn.

Vectors that are null, zero, or hold nulls or non-finite numbers link with nothing, and neither do rows with a null vec_id,
whose component is null. Vectors of different lengths don't link; each length is compared by itself.
Repeated rows are vectors of their own; rows of one vec_id are one node. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

#: Vectors of a tile, about, and of a square's side.
TILE, SIDE = 4096, 1024
#: Share of components that is added up in each step.
STEPS = (0.25, 0.5, 1.0)
#: How far rounding may put a cosine from its value in the vectors as they came.
NEAR = 1e-9


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(1, keepdims=True)  # no square of it under- or overflows
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _array(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """Squares (first of a, first of b, links) with any link, for unit vectors a and b."""
    pa_, pb = a @ axes, b @ axes
    d = axes.shape[1]
    cuts = sorted({max(1, int(np.ceil(d * s))) for s in STEPS})
    rest_a, rest_b = ([np.sqrt(np.maximum(0, np.square(p[:, c:]).sum(1))) for c in cuts] for p in (pa_, pb))
    for i in range(0, len(a), SIDE):
        for j in range(i if same else 0, len(b), SIDE):
            x, y = pa_[i : i + SIDE], pb[j : j + SIDE]
            c = cuts[0]
            product = x[:, :c] @ y[:, :c].T
            alive = product + rest_a[0][i : i + SIDE, None] * rest_b[0][None, j : j + SIDE] >= threshold - NEAR
            if same and i == j:
                np.fill_diagonal(alive, False)
            r, s = np.nonzero(alive)
            sums = product[r, s]
            for n in range(1, len(cuts)):
                if not len(r):
                    break
                span = slice(cuts[n - 1], cuts[n])
                for at in range(0, len(r), 1 << 16):
                    k = slice(at, at + (1 << 16))
                    sums[k] += np.einsum("ij,ij->i", x[r[k], span], y[s[k], span])
                stay = sums + rest_a[n][i + r] * rest_b[n][j + s] >= threshold - NEAR
                r, s, sums = r[stay], s[stay], sums[stay]
            if not len(r):
                continue
            close = np.flatnonzero(np.abs(sums - threshold) <= NEAR)
            for at in close:
                sums[at] = float(a[i + r[at]] @ b[j + s[at]])
            r, s = r[sums >= threshold], s[sums >= threshold]
            if len(r):
                found = np.zeros(alive.shape, bool)
                found[r, s] = True
                yield i, j, found


def _parts(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a square the least id that links reach; its own if none."""
    a, b = ids_a.copy(), ids_b.copy()
    none = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(b, np.where(linked, a[:, None], none).min(0))
        new_a = np.minimum(a, np.where(linked, new_b[None, :], none).min(1))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes of the unit vectors as columns, the largest first. Every vector counts; partitions send sums of products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                u = _units(_array(batch.column(0), width))
                total += u.T @ u
        yield pa.RecordBatch.from_pydict({"place": np.arange(width * width), "value": total.ravel()})

    sums = vectors.select("embedding").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(width * width)
    for row in sums:
        total[row.place] = row.value
    return np.linalg.eigh(total.reshape(width, width))[1][:, ::-1].copy()


def reaches(bounds: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last tile that each tile meets, by the bounds of the tiles' first components: angles from the
    first axis that differ more than the threshold's keep the cosine below it. Both ends rise from tile to tile."""
    edges = np.arccos(np.clip(np.concatenate([[-1.0], bounds, [1.0]]), -1, 1))  # falling
    reach, tiles = np.arccos(threshold) + 1e-6, len(edges) - 1
    last = np.searchsorted(-edges[:-1], reach - edges[1:], side="right") - 1
    first = np.searchsorted(-edges[1:], -(edges[:-1] + reach), side="left")
    return np.minimum(first, np.arange(tiles)), np.maximum(last, np.arange(tiles))


def _links(classes: DataFrame, width: int, n: int, threshold: float, tile: int) -> DataFrame:
    """(u, v, n): a name v and a number n of links of the class u, from each square that has any; classes has embedding, id, many."""
    axes = principal_axes(classes, width)
    tiles = max(1, -(-n // tile))

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"first": _units(_array(batch.column(0), width)) @ axes[:, 0]})

    bounds = np.zeros(0)
    if tiles > 1:
        ranks = [i / tiles for i in range(1, tiles)]
        firsts = classes.select("embedding").mapInArrow(leading, "first double")
        bounds = np.array(firsts.select(F.percentile_approx("first", ranks, 100 * tiles)).first()[0])
    meets = reaches(bounds, threshold)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mine = np.searchsorted(bounds, _units(_array(batch.column(0), width)) @ axes[:, 0])
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int32()) for x in (mine, meets[0][mine], meets[1][mine]))], names=["embedding", "id", "many", "tile", "low", "high"])

    tiled = classes.select("embedding", "id", "many").mapInArrow(place, "embedding array<double>, id long, many long, tile int, low int, high int")
    as_left = tiled.withColumn("other", F.explode(F.sequence("tile", "high"))).select(F.col("tile").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "id", "many", "embedding")
    before = tiled.where("low < tile").withColumn("other", F.explode(F.sequence(F.col("low"), F.col("tile") - 1)))
    as_right = before.select(F.col("other").alias("i"), F.col("tile").alias("j"), F.lit(1).alias("side"), "id", "many", "embedding")

    def compare(group: pa.Table) -> pa.Table:
        side, ids, many = (group.column(c).to_numpy() for c in ("side", "id", "many"))
        units = _units(_array(group.column("embedding").combine_chunks(), width))
        same = bool((group.column("i")[0].as_py()) == group.column("j")[0].as_py())
        left = side == 0
        right = left if same else ~left
        a, b, ids_a, ids_b, many_a, many_b = units[left], units[right], ids[left], ids[right], many[left], many[right]
        out: list[tuple[np.ndarray, ...]] = []
        for i, j, found in links(a, b, axes, threshold, same):
            x, y = ids_a[i : i + SIDE], ids_b[j : j + SIDE]
            names = _parts(found, x, y)
            for who, name, count in ((x, names[0], found @ many_b[j : j + SIDE]), (y, names[1], found.T @ many_a[i : i + SIDE])):
                if same and i == j and who is y:
                    continue  # the square is symmetric
                met = count > 0
                out.append((who[met], name[met], count[met]))
        u, v, n = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"u": u.astype(np.int64), "v": v.astype(np.int64), "n": n.astype(np.int64)})

    return written(as_left.unionAll(as_right).groupBy("i", "j").applyInArrow(compare, "u long, v long, n long"), "tiles-links")


def grouped_vectors(table: DataFrame, threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of table(vec_id, embedding)."""
    numbers = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = numbers.where(F.col("vec_id").isNotNull() & fine)
    classes = written(valid.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("many")), "tiles-classes")
    found = None
    for width, n in sorted(classes.groupBy(F.size("embedding")).count().collect()):
        some = _links(classes.where(F.size("embedding") == width), width, n, threshold, tile)
        found = some if found is None else found.unionAll(some)
    rows = numbers.select("vec_id", F.when(F.col("vec_id").isNotNull() & fine, F.col("embedding")).alias("embedding"))
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.groupBy("u").agg(F.sum("n").alias("n"))
    known = classes.join(counts, classes.id == counts.u, "left").select(F.col("embedding").alias("e"), "id", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    parts = components(found.select("u", "v"))
    known = known.join(parts, known.id == parts.node, "left").select("e", "n_links", F.coalesce("component", "id").alias("component"))
    rows = rows.join(known, rows.embedding == known.e, "left")
    component_id = F.coalesce("component", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"))
