"""Document fingerprints: bottom-k sketches of shingle hashes, as Column expressions.

A sketch is a struct: hashes, the k least distinct 64-bit hashes of the shingles in ascending order, and full, whether
there may be more. The sketch of a union is the k least of both sketches' hashes, so sketches of parts merge in any
order. Of two sketches, the k least hashes of the union tell how many of them both have: that share estimates the
resemblance |A & B| / |A | B|; with k hashes its standard error is sqrt(r (1 - r) / k), and below k it is exact.

Words are runs of other than ASCII white space; a shingle is five of them, or the whole sequence of a shorter text.
Null and empty texts, and those of white space alone, have the empty sketch; two empty sketches resemble each other
fully, as equal texts do, and an empty one resembles no other. Very long texts are one row's array of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K, WORDS = 128, 5
#: Sketches that are merged at a time, on the average.
FAN = 64
_SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, possibly with empty strings at the ends."""
    return F.split(F.coalesce(text, F.lit("")), _SPACES)


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """Distinct 64-bit hashes of the n-word shingles of a text."""
    hashed = F.transform(F.filter(words(text), lambda w: w != ""), lambda w: F.xxhash64(w))
    return F.array_distinct(_shingles(hashed, n))


def _shingles(hashed: Column, n: int) -> Column:
    """An array of word hashes to those of its shingles; the let-binding over a one-element array keeps it evaluated once."""

    def of(h: Column) -> Column:
        whole = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n))))
        return F.when(F.size(h) >= n, runs).when(F.size(h) > 0, whole).otherwise(F.slice(h, 1, 0))

    return F.get(F.transform(F.array(hashed), of), F.lit(0))


def sketch(hashes: Column, k: int = K) -> Column:
    """The sketch of an array of distinct hashes."""
    return F.struct(F.slice(F.sort_array(hashes), 1, k).alias("hashes"), (F.size(hashes) > k).alias("full"))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what a and b are sketches of."""
    both = F.array_union(a.hashes, b.hashes)
    return F.struct(F.slice(F.sort_array(both), 1, k).alias("hashes"), (a.full | b.full | (F.size(both) > k)).alias("full"))


def distinct_count(a: Column) -> Column:
    """Estimated number of distinct shingles: exact if the sketch isn't full, else by the density of its hashes."""
    span = F.element_at(a.hashes, -1).cast("double") + F.lit(2.0**63)
    return F.when(a.full, (F.size(a.hashes) - 1) * F.lit(2.0**64) / span).otherwise(F.size(a.hashes).cast("double"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketched sets."""
    both = F.array_union(a.hashes, b.hashes)
    short = F.size(both) <= k
    common = F.array_intersect(a.hashes, b.hashes)
    last = F.element_at(F.slice(F.sort_array(both), 1, k), -1)
    met = F.when(short, F.size(common)).otherwise(F.size(F.filter(common, lambda h: h <= last)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(met / F.least(F.size(both), F.lit(k)).cast("double"))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's set that b's set has: 1 for an empty a."""
    share = resemblance(a, b, k) * distinct_count(merge(a, b, k)) / distinct_count(a)
    return F.when(F.size(a.hashes) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def printed(a: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, and a + if there may be more."""
    return F.concat(F.concat_ws("", F.transform(a.hashes, lambda h: F.lpad(F.hex(h), 16, "0"))), F.when(a.full, "+").otherwise(""))


def fingerprint(docs: DataFrame, k: int = K, n: int = WORDS) -> DataFrame:
    """docs(text, ...) with a column sketch."""
    return docs.withColumn("sketch", sketch(shingle_hashes(F.col("text"), n), k))


def merged(sketches: DataFrame, *keys: str, k: int = K) -> DataFrame:
    """The sketch of each group of rows (keys..., sketch), merged some at a time in a tree of FAN-fold levels."""
    now = sketches.select(*keys, "sketch").distinct()
    most = now.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    now = now.withColumn("of", F.pmod(F.xxhash64("sketch"), F.lit(max(1, -(-most // FAN)))))
    while most:
        hashes = F.array_distinct(F.flatten(F.collect_list("sketch.hashes")))
        now = now.groupBy(*keys, "of").agg(hashes.alias("all"), F.max("sketch.full").alias("was"))
        one = F.struct(F.slice(F.sort_array("all"), 1, k).alias("hashes"), (F.col("was") | (F.size("all") > k)).alias("full"))
        most = -(-most // FAN)
        now = now.select(*keys, F.floor(F.col("of") / FAN).alias("of"), one.alias("sketch"))
        if most == 1:
            break
    return now.select(*keys, "sketch")


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, taker, taker_chars): in descending order of doc_id, null last, the taker is the document before;
    the first document's taker is the last. n_chars is the largest of a doc_id's rows.

    Ids are dealt by range; the partitions' ends are joined over one row for each partition.
    """
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    ids = docs.select("doc_id", n.alias("n_chars")).groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("rows"))
    dealt = written(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "neighbours")
    me = F.struct("doc_id", "n_chars")
    order = Window.orderBy("part")
    firsts = dealt.groupBy("part").agg(F.min(me).alias("first"))
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("following"))
    within = dealt.withColumn("next", F.lead(me).over(Window.partitionBy("part").orderBy("doc_id"))).join(firsts, "part")
    taker = F.coalesce("next", "following")
    return within.select("doc_id", "n_chars", "rows", taker.doc_id.alias("taker"), taker.n_chars.alias("taker_chars"))


def compared(docs: DataFrame, k: int = K, n: int = WORDS) -> DataFrame:
    """Each document of docs(doc_id, text) with its sketch, its edited text and that one's sketch, and the next document's.

    The edited text has the last third of its code points (rounded down) replaced by the first as many, or all, of the
    next document's. Columns: doc_id, text, n_chars, edited, sketch, edited_sketch, next_sketch. Of rows with one
    doc_id, each is compared with the next lower doc_id's row whose text hashes least.
    """
    near = neighbours(docs)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = near.select(F.col("doc_id").alias("giver"), "taker", "taker_chars")
    given = texts.join(ids, texts.doc_id.eqNullSafe(ids.giver)).select(
        "taker",
        F.left("text", F.floor(F.col("taker_chars") / 3).cast("int")).alias("head"),
        sketch(shingle_hashes(F.col("text"), n), k).alias("next_sketch"),
        F.xxhash64("text").alias("order"),
    )
    if near.where("rows > 1").limit(1).count():
        given = given.withColumn("n", F.row_number().over(Window.partitionBy("taker").orderBy("order"))).where("n = 1").drop("n")
    third = F.floor(F.char_length("text") / 3).cast("int")
    met = (
        texts.join(given, texts.doc_id.eqNullSafe(given.taker))
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.concat(F.left("text", F.char_length("text") - third), F.left("head", third)))
    )
    return met.select(
        "doc_id", "text", "n_chars", "edited",
        sketch(shingle_hashes(F.col("text"), n), k).alias("sketch"),
        sketch(shingle_hashes(F.col("edited"), n), k).alias("edited_sketch"),
        "next_sketch",
    )
