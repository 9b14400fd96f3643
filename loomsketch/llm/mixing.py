"""Mixing sources to target weights by pivotal rounding of fractional copies.

A document of a source whose target is f times its size should be taken f times: floor(f) times surely, and once
more with probability f - floor(f). Pivotal rounding decides the extra copies dependently. Two undecided documents
trade words: one gains what the other loses, in a random direction chosen so that neither's expectation changes, until
one of the two is decided. A source's expected words are so kept at every step, and in the end a single document of it
is left undecided, which goes to the nearer side. Blocks of about BLOCK documents each leave one residual document;
the residuals are gathered into blocks again, level by level. A block takes its largest documents first, so that they
settle among themselves and a small one is left. All of it is DataFrame operations.

Nulls: a null text has size 0; a null source is a source of its own, ranked last; a null doc_id is an id like others.
Rows that agree in doc_id, source and size are decided together and all get the same copies. Size 0 is never taken.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, unit_interval, written

#: Documents of a block, on the average; a block is folded in one task's memory.
BLOCK = 96


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) of rows (source, size): share of all sizes dealt by weight, none above cap times its own.

    In order of cap * size / weight, a source is at its cap if its own share of what the earlier ones leave exceeds it;
    from the first that isn't, all get the same words for each unit of weight.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.get(F.array(*map(F.lit, weights)), ((F.row_number().over(ranked) - 1) % len(weights)).cast("int")))
        .withColumn("most", cap * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("budget", share * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("place", F.row_number().over(rising))
        .withColumn("common", F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(Window.partitionBy()))
    )
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("common.level")))
    return levels.select("source", "source_size", target.alias("target"))


def _fold(items: Column, level: int, seed: int) -> Column:
    """Pivotal rounding along an array of struct(..., unit, s, m): of s words, m are expected. Gives (unit, s, m, done)."""

    def step(acc: Column, x: Column) -> Column:
        up = F.least(acc.s - acc.m, x.m)
        down = F.least(acc.m, x.s - x.m)
        rises = unit_interval(F.lit(seed), F.lit(level), acc.unit, x.unit) * (up + down) < down
        first = F.when(rises, acc.s - acc.m <= x.m).otherwise(acc.m <= x.s - x.m)  # the first of the two is decided
        left = F.when(rises, F.when(first, x.m - up).otherwise(acc.m + up)).otherwise(F.when(first, x.m + down).otherwise(acc.m - down))
        extra = F.when(first == rises, F.lit(1)).otherwise(F.lit(0))
        return F.struct(
            F.when(first, x.unit).otherwise(acc.unit).alias("unit"),
            F.when(first, x.s).otherwise(acc.s).alias("s"),
            left.alias("m"),
            F.concat(acc.done, F.array(F.struct(F.when(first, acc.unit).otherwise(x.unit).alias("unit"), extra.alias("extra")))).alias("done"),
        )

    head = F.get(items, F.lit(0))
    none = F.slice(F.array(F.struct(head.unit.alias("unit"), F.when(head.s > 0, 1).otherwise(0).alias("extra"))), 1, 0)
    start = F.struct(head.unit.alias("unit"), head.s.alias("s"), head.m.alias("m"), none.alias("done"))
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, step)


def plan_copies(docs: DataFrame, *, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 17, size: Column | None = None) -> DataFrame:
    """How often the mix takes each row of docs(doc_id, text, source, ...).

    Returns a row (doc_id, source, size, source_size, target, copies) for each input row.
    """
    sized = docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size"))
    targets = written(source_targets(sized, weights, share, cap).withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "mix-targets").withColumnRenamed("source", "of")
    same = sized.source.eqNullSafe(targets.of)
    units = (
        sized.groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("rows"))
        .join(targets, same)
        .withColumn("base", F.floor("times"))
        .withColumn("part", F.when(F.col("size") > 0, F.col("times") - F.col("base")).otherwise(0.0))
        .select("source", "source_size", "target", "base", "part", F.struct("doc_id", "size", "rows").alias("unit"))
    )
    units = written(units, "mix-units")
    blocks = units.where("part > 0").groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    blocks = blocks.withColumnRenamed("source", "of")
    drawn = F.xxhash64(F.lit(seed), F.col("unit"))
    now = (
        units.where("part > 0")
        .join(blocks, units.source.eqNullSafe(blocks.of))
        .select("source", F.pmod(F.xxhash64(F.lit(~seed), F.col("unit")), F.col("blocks")).alias("block"), "unit", (F.col("unit.size") * F.col("unit.rows")).cast("double").alias("s"), "part")
        .withColumn("m", F.col("s") * F.col("part"))
    )
    decided, level = [], 0
    while most:
        items = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("largest"), drawn.alias("order"), "unit", "s", "m")))
        folded = now.groupBy("source", "block").agg(items.alias("items")).select("source", "block", _fold(F.col("items"), level, seed).alias("f"))
        folded = written(folded, f"mix-level{level}")
        decided.append(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.unit", "d.extra"))
        now = folded.select("source", F.floor(F.col("block") / BLOCK).alias("block"), "f.unit", "f.s", "f.m")
        if most == 1:
            decided.append(now.select("source", "unit", F.when(F.col("m") * 2 >= F.col("s"), 1).otherwise(0).alias("extra")))
            break
        most, level = -(-most // BLOCK), level + 1
    rest = units.where("part = 0").select("source", "unit", F.lit(0).alias("extra"))
    for more in decided:
        rest = rest.unionAll(more)
    known = rest.join(targets, rest.source.eqNullSafe(targets.of))
    return known.select(
        "unit.doc_id", "source", "unit.size", "source_size", "target",
        F.when(F.col("unit.size") > 0, F.floor("times") + F.col("extra")).otherwise(0).cast("int").alias("copies"),
        F.explode(F.sequence(F.lit(1), F.col("unit.rows").cast("int"))).alias("_row"),
    ).drop("_row")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as plan_copies() says, with docs' own columns."""
    plan = plan_copies(docs, **options).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies")).distinct()
    with_size = docs.withColumn("_words", word_count(F.col("text")) if options.get("size") is None else options["size"])
    met = with_size.join(plan, with_size.doc_id.eqNullSafe(plan._id) & with_size.source.eqNullSafe(plan._source) & (with_size._words == plan._size))
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[met[c] for c in docs.columns])
