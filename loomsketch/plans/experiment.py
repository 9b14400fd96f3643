"""Experiments: sequences in groups, sketched by several methods, and how well distances follow edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pairs, stats
from ..sources.shared import written
from .engine import Parameters, distance_column, sketched


def distances(sequences: DataFrame, methods: list[Parameters], reruns: int = 1) -> DataFrame:
    """(algo, rerun, s1, s2, dist) of the pairs in sequences(seq_id, group, seq)'s groups, with algo ED for edit distance."""
    plans = [(Parameters(method="ED"), 0), *((m.reseeded(r), r) for m in methods for r in range(reruns))]
    out = None
    for p, run in plans:
        own = sketched(sequences.select("seq_id", "group", "seq"), p).select("seq_id", "group", "sketch")
        met = pairs.in_group(own, "seq_id", "group", ["sketch"])
        rows = met.select(F.lit(p.method).alias("algo"), F.lit(run).alias("rerun"), F.col("i").alias("s1"), F.col("j").alias("s2"), distance_column(F.col("sketch_i"), F.col("sketch_j"), p).alias("dist"))
        out = rows if out is None else out.unionAll(rows)
    return out


def against_edit_distance(rows: DataFrame) -> DataFrame:
    """distances()'s rows with a column ed, without the edit distances' own."""
    ed = rows.where("algo = 'ED'").select("s1", "s2", F.col("dist").alias("ed"))
    return rows.where("algo <> 'ED'").join(ed.hint("merge"), ["s1", "s2"])  # there are as many as pairs: not by a broadcast


def quality(rows: DataFrame, thresholds: float | list[float], lengths: int | DataFrame) -> DataFrame:
    """(algo, spearman mean and deviation over reruns, spearman of the median and the mean distance, auroc at each threshold).

    Far are pairs whose edit distance is at least threshold times the length: one number, or in lengths(seq_id, n) that of the pair's first
    sequence. One threshold gives a column auroc, several auroc_0.1 and so on, with _ for the point."""
    met = written(against_edit_distance(rows), "experiment")
    runs = stats.spearman(met, "dist", "ed", "algo", "rerun").groupBy("algo").agg(F.avg("spearman").alias("spearman"), F.stddev_pop("spearman").alias("deviation"))
    merged = written(met.groupBy("algo", "s1", "s2").agg(stats.median("dist").alias("median"), F.avg("dist").alias("mean"), F.first("ed").alias("ed")), "experiment")
    of_median = stats.spearman(merged, "median", "ed", "algo").withColumnRenamed("spearman", "spearman_of_median")
    of_mean = stats.spearman(merged, "mean", "ed", "algo").withColumnRenamed("spearman", "spearman_of_mean")
    if isinstance(lengths, DataFrame):
        sized = merged.join(lengths.select(F.col("seq_id").alias("s1"), F.col("n").alias("_length")).hint("merge"), "s1")
    else:
        sized = merged.withColumn("_length", F.lit(lengths))
    out = runs.join(of_median, "algo").join(of_mean, "algo")
    several = isinstance(thresholds, list)
    for threshold in thresholds if several else [thresholds]:
        labelled = sized.withColumn("far", F.col("ed") >= threshold * F.col("_length"))
        name = f"auroc_{threshold}".replace(".", "_") if several else "auroc"
        out = out.join(stats.auroc(labelled, "mean", "far", "algo").withColumnRenamed("auroc", name), "algo")
    return out
