"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on whole shingle sets.

A document's set are its distinct shingles of 4 words, lower-cased in ASCII; a shorter text is one shingle. Documents of
equal sets are a class, and only its least doc_id goes on. TREES sorted orders of the rest follow DEPTH minima each. In
an order, a row's candidates are the rows just before it with the longest common prefix, and the first row of its
region. Orders are dealt over tasks by ranges, so no common prefix is a single task's. A region is the rows that share a prefix; it is as deep, from SHALLOW on, as it takes to leave no more than
DENSE rows in sight, so a crowded part of the order is looked at more closely than a sparse one.

Candidates agree in AGREE of all minima at least. Of each document, the two that agree in most are compared first, and
components drawn from what their sets confirm. All that is left undecided comes next: candidates in different components;
and in regions at REGION minima that are too large for their rows' few neighbours to have covered, all rows of different
components that agree in so many minima. Signatures alone tell which those are, and edges that span them, not the pairs,
draw groups of rows that may link. A text is sent to its group once for every BLOCK of rows it must meet; there common
shingles are counted by a matrix product, and edges that span the links returned. Rows of a region's or group's most
frequent component aren't compared with each other. So no pair of rows that share REGION minima of an order and agree in
AGREE stays undecided. Two sets of similarity 0.8 share them in one of the orders at least with probability 1 - 1e-5. A
link is confirmed by the numbers of shingles in both sets and in either, as integers.

Nulls: null and empty texts have no shingles and link with nothing; rows with a null doc_id too, and their component is
null. Rows of one doc_id are one node. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, join_frequent, written
from .words import Words, grouped, mixed, runs

SHINGLE = 4
TREES, DEPTH = 16, 6
SHALLOW, REGION, DENSE, BACK = 2, 3, 64, 3
#: Of TREES * DEPTH minima, candidates agree in so many at least (by a byte of each). Sets of similarity 0.8 agree in fewer
#: with a probability of 1e-6; on average they agree in 77.
AGREE = 57
#: Rows of a large region that are compared with as many others at a time, and columns of a product.
BLOCK, COLUMNS = 512, 8192

_FACTORS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text."""
    for a, b in grouped(texts):
        words = Words([t.lower() for t in texts[a:b]])
        hashes = words.hashes()
        whole = runs(hashes, n)
        for first, last in zip(words.bounds[:-1], words.bounds[1:], strict=True):
            count = last - first
            yield np.unique(whole[first : last - n + 1]) if count >= n else runs(hashes[first:last], count) + np.uint64(count) if count else whole[:0]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the common shingles are so many percent of all."""
    small, large = sorted((a, b), key=len)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def signatures(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, size, s1, s2, minima, brief): s1 and s2 identify the set, minima are TREES * DEPTH big-endian u32, and brief
    has the last byte of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h in shingles([(t or "").encode() for t in batch.column(1).to_pylist()], n):
                s1, s2 = (int((mixed(h ^ np.uint64(k)).sum() if len(h) else np.uint64(0)).view(np.int64)) for k in (0x1234567, 0x89ABCDE))
                minima = np.zeros(TREES * DEPTH, ">u4")
                if len(h):
                    for i in range(0, len(minima), 16):
                        some = slice(i, i + 16)
                        least = np.full(16, ~np.uint64(0))
                        for at in range(0, len(h), 4096):
                            least = np.minimum(least, (h[at : at + 4096, None] * _FACTORS[None, some]).min(0))
                        minima[some] = least >> np.uint64(32)
                rows.append((len(h), s1, s2, minima.tobytes(), minima.astype(np.uint8).tobytes()))
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "size", "s1", "s2", "minima", "brief"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, s1 long, s2 long, minima binary, brief binary")


def orders(classes: DataFrame) -> DataFrame:
    """(tree, path, id, size) of classes(id, size, minima): the minima of each order."""
    path = F.substring("minima", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * DEPTH))
    return classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select("tree", path.alias("path"), "id", "size")


def candidates(sorted_paths: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a > b, once for each order that names the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None  # the last rows before the batch, and the first rows of its open regions by depth
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, ids, size = (batch.column(i).to_numpy() for i in (0, 2, 3))
            path = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, DEPTH)
            old = 0
            if tail is not None:
                old = len(tail[0])
                tree, path, ids, size = (np.concatenate(x) for x in zip(tail, (tree, path, ids, size), strict=True))
            same = (path[1:] == path[:-1]) & (tree[1:] == tree[:-1])[:, None]
            lcp = np.concatenate([[0], np.logical_and.accumulate(same, axis=1).sum(1)])
            depth, first = np.full(len(ids), DEPTH), np.zeros(len(ids), np.int64)
            for d in range(DEPTH, SHALLOW - 1, -1):
                fresh = lcp < d
                group = np.cumsum(fresh) - 1
                few = np.bincount(group)[group] <= DENSE
                depth[few] = d
                begin = np.flatnonzero(fresh)[group]
                first[(depth == d)] = begin[(depth == d)]
            found = []
            lowest = lcp.copy()
            for back in range(1, BACK + 1):
                if back > 1:
                    lowest[back:] = np.minimum(lowest[back:], lcp[1 : len(lcp) - back + 1])
                x = np.flatnonzero((lowest >= depth) & (np.arange(len(ids)) >= back))
                found.append((x, x - back))
            x = np.flatnonzero(first < np.arange(len(ids)) - BACK)
            found.append((x, first[x]))
            x, y = (np.concatenate(z) for z in zip(*found, strict=True))
            ok = (x >= old) & (ids[x] != ids[y]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
            x, y = ids[x[ok]], ids[y[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])
            begins = [int(np.flatnonzero(lcp < d)[-1]) for d in range(SHALLOW, DEPTH + 1)]
            keep = sorted({*begins, *range(max(0, len(ids) - BACK), len(ids))})
            tail = tuple(c[keep] for c in (tree, path, ids, size))

    return sorted_paths.mapInArrow(run, "a long, b long")


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose signatures agree in AGREE places at least, and in how many."""
    met = pairs
    for side in "ab":
        met = met.join(classes.select(F.col("id").alias(side), F.col("brief").alias(f"brief_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_briefs(batch.column(i).to_pylist()) for i in (2, 3))
            agree = pa.array((left == right).sum(1), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), agree], names=["a", "b", "agree"])

    return met.select("a", "b", "brief_a", "brief_b").mapInArrow(run, "a long, b long, agree int").where(F.col("agree") >= AGREE)


def _briefs(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), TREES * DEPTH)


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, n: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets are so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([t.encode() for t in batch.column(i).to_pylist()] for i in (2, 3))
            good = [similar(x, y, percent) for x, y in zip(shingles(left, n), shingles(right, n), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    met = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return met.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def tree_of_links(ids: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> pa.Table:
    """Edges (id, least id that links reach); linked has a row for each of the rows left and a column for each of those right."""
    names, far = ids.copy(), np.iinfo(np.int64).max
    while left.size and right.size:
        before = names.copy()
        names[left] = np.minimum(names[left], np.where(linked, names[right][None], far).min(1))
        names[right] = np.minimum(names[right], np.where(linked, names[left][:, None], far).min(0))
        if (names == before).all():
            break
    moved = names < ids
    return pa.table({"a": ids[moved], "b": names[moved]})


def links_between(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets left are similar to which of those right."""
    sizes = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner, met = owner[shared], np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        present = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - first)), np.float32)
        present[owner[a:b], column[a:b] - first] = 1
        met += present[left] @ present[right].T
    met = met.astype(np.int64)
    return (100 * met >= percent * (sizes[left][:, None] + sizes[right][None] - met)) & (met > 0)


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """The n rows(region, id, of), of being a component, as (region, p, q, id, of, left, right): the cells in which, together,
    each row outside its region's most frequent component is on the left where each other row of the region is on the
    right. Regions that hold one component have none. A row goes to a cell for every BLOCK of those on the other side."""
    of_each = rows.groupBy("region", "of").agg(F.count("*").alias("n"))
    heads = of_each.groupBy("region").agg(F.sum("n").alias("all"), F.max(F.struct("n", "of")).alias("main")).where("all > main.n")
    heads = heads.select("region", F.col("all").alias("many"), F.col("main.of").alias("main"), _blocks(F.col("all") - F.col("main.n")).alias("ps"), _blocks(F.col("all")).alias("qs"))
    met = join_frequent(rows, heads, ["region"], n).withColumn("stray", F.col("of") != F.col("main"))
    p, q = (F.pmod(F.xxhash64("id"), c).cast("int") for c in ("ps", "qs"))
    met = met.withColumns({"own_p": p, "own_q": q})
    as_left = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda i: F.struct(F.col("own_p").alias("p"), i.alias("q")))
    as_right = F.transform(F.sequence(F.lit(0), F.col("ps") - 1), lambda i: F.struct(i.alias("p"), F.col("own_q").alias("q")))
    cells = F.when(F.col("stray"), F.array_union(as_left, as_right)).otherwise(as_right)
    met = met.withColumn("cell", F.explode(cells)).select("region", "cell.*", "id", "of", "stray", "own_p", "own_q")
    return met.select("region", "p", "q", "id", "of", (F.col("stray") & (F.col("p") == F.col("own_p"))).alias("left"), (F.col("q") == F.col("own_q")).alias("right"))


def _blocks(rows: Column) -> Column:
    return F.ceil(rows / BLOCK).cast("int")


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return group.column("id").to_numpy(), *(np.flatnonzero(group.column(c).to_numpy()) for c in ("left", "right"))


def undecided(rows: DataFrame, n_rows: int, classes: DataFrame) -> DataFrame:
    """Edges (a, b) that span, within each region of the n_rows rows(region, id, of), the pairs of different components whose
    signatures agree in AGREE places at least."""
    met = dealt(rows, n_rows).join(classes.select("id", "brief"), "id")

    def run(group: pa.Table) -> pa.Table:
        ids, left, right = _sides(group)
        of, brief = group.column("of").to_numpy(), _briefs(group.column("brief").to_pylist())
        agree = np.zeros((len(left), len(right)), np.int16)
        for at in range(TREES * DEPTH):
            agree += brief[left, at][:, None] == brief[right, at][None]
        return tree_of_links(ids, left, right, (agree >= AGREE) & (of[left][:, None] != of[right][None]))

    return met.groupBy("region", "p", "q").applyInArrow(run, "a long, b long")


def decided(rows: DataFrame, n_rows: int, docs: DataFrame, percent: int, n: int) -> DataFrame:
    """Edges (a, b) that span, within each region of the n_rows rows(region, id, of), the links between different components."""
    met = dealt(rows, n_rows).join(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), "id")

    def run(group: pa.Table) -> pa.Table:
        ids, left, right = _sides(group)
        sets = list(shingles([t.encode() for t in group.column("text").to_pylist()], n))
        return tree_of_links(ids, left, right, links_between(left, right, sets, percent))

    return met.groupBy("region", "p", "q").applyInArrow(run, "a long, b long")


def grouped_documents(docs: DataFrame, percent: int = 80, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text)."""
    whole = written(signatures(docs, n), "forest-signatures")
    classes = whole.where("size > 0 and doc_id is not null").groupBy("s1", "s2")
    classes = classes.agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("minima").alias("minima"), F.first("brief").alias("brief"), F.count("*").alias("many"))
    classes = written(classes, "forest-classes")
    signed = written(whole.drop("minima", "brief"), "forest-sizes")
    discard(whole)
    paths = orders(classes.select("id", "size", "minima"))
    in_order = paths.repartitionByRange("tree", "path", "id").sortWithinPartitions("tree", "path", "id")
    near = written(candidates(in_order, percent).distinct(), "forest-candidates")
    agreed = written(agreeing(near, classes), "forest-candidates")
    discard(near)
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("agree"), "b"))
    early = agreed.withColumn("n", best).where("n <= 2").select("a", "b")
    links = written(confirmed(early, docs, percent, n), "forest-links")
    so_far = written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "forest-components")

    def component(of: DataFrame, column: str, name: str) -> DataFrame:
        known = so_far.select(F.col("node").alias(column), F.col("component").alias(name))
        return of.join(known, column, "left").withColumn(name, F.coalesce(name, column))

    apart = component(component(agreed.select("a", "b"), "a", "of_a"), "b", "of_b").where("of_a <> of_b").select("a", "b")
    region = F.xxhash64("tree", F.substring("path", F.lit(1), F.lit(4 * REGION)))
    rows = paths.select(region.alias("region"), "id")
    large = written(rows.groupBy("region").agg(F.count("*").alias("many")).where(F.col("many") > BACK + 1), "forest-large")
    crowded = join_frequent(rows, large, ["region"], TREES * classes.count())
    regions = written(component(crowded, "id", "of"), "forest-regions")
    discard(large)
    open_edges = written(undecided(regions, regions.count(), classes).unionAll(apart.join(early, ["a", "b"], "left_anti")).toDF("u", "v"), "forest-undecided")
    groups = written(components(open_edges), "forest-groups").select(F.col("node").alias("id"), F.col("component").alias("region"))
    rest = written(decided(component(groups, "id", "of"), groups.count(), docs, percent, n), "forest-links")
    same = join_frequent(signed.where("size > 0 and doc_id is not null"), classes.select("s1", "s2", "id", "many"), ["s1", "s2"], signed.count())
    same = same.where("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    edges = links.unionAll(rest).toDF("u", "v").unionAll(same)
    found = written(components(edges), "forest-components")
    for table in (agreed, links, rest, so_far, regions, open_edges, groups, classes):
        discard(table)
    rows = signed.select("doc_id", F.col("size").alias("n_shingles")).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component_id = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component_id.alias("component_id"), _kept(component_id).alias("kept"))


def _kept(component_id: Column) -> Column:
    return component_id.isNull() | (F.col("doc_id") == component_id)
