"""Rank statistics, ROC curves and summaries of distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered, ranked, running


def fractional_rank(df: DataFrame, value: str, *by: str, name: str = "rank") -> DataFrame:
    """Ranks from 1 with the mean rank for ties, within groups.

    Values are counted first; the counts below a value are running sums over ranges of values, so neither a large group nor the whole
    table is one task's. Rows meet their ranks by a merge: small files hold many rows, and a broadcast of either side would pass them through the driver.
    """
    counted = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    below = running(counted, list(by), [value], {"_below": "_n"})
    ranks = below.withColumn(name, F.col("_below") + (F.col("_n") + 1) / 2).drop("_n", "_below")
    return df.join(ranks.hint("merge"), [*by, value])


def pearson(a: Column, b: Column) -> Column:
    """Correlation, without large sums of squares: 1 if both are constant, 0 if one is. Rows with a null count for neither."""
    met = a.isNotNull() & b.isNotNull()
    a, b = F.when(met, a.cast("double")), F.when(met, b.cast("double"))
    same_a, same_b = F.min(a) == F.max(a), F.min(b) == F.max(b)
    return F.when(same_a & same_b, 1.0).when(same_a | same_b, 0.0).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def spearman(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """(by..., spearman) by fractional ranks."""
    ranked = fractional_rank(fractional_rank(df, a, *by, name="_ra"), b, *by, name="_rb")
    return ranked.groupBy(*by).agg(pearson(F.col("_ra"), F.col("_rb")).alias("spearman"))


def spearman_ordinal(df: DataFrame, a: str, b: str, order: list[str], *by: str) -> DataFrame:
    """(by..., spearman) by ranks without ties, which follow order. A group's rows are numbered on from those of the groups before it, which
    correlation doesn't mind."""
    for column, name in ((a, "_ra"), (b, "_rb")):
        df = numbered(df, *by, column, *order, name=name)
    return df.groupBy(*by).agg(pearson(F.col("_ra"), F.col("_rb")).alias("spearman"))


def auroc(df: DataFrame, score: str, positive: str, *by: str) -> DataFrame:
    """(by..., auroc): how probably a positive row's score exceeds another's, ties half; null without both kinds."""
    ranked = fractional_rank(df, score, *by, name="_r")
    p = F.sum(F.when(F.col(positive), 1.0).otherwise(0.0))
    n = F.sum(F.when(F.col(positive), 0.0).otherwise(1.0))
    r = F.sum(F.when(F.col(positive), F.col("_r")).otherwise(0.0))
    return ranked.groupBy(*by).agg(F.try_divide(r - p * (p + 1) / 2, p * n).alias("auroc"))


def roc_curve(df: DataFrame, score: str, positive: str, *by: str) -> DataFrame:
    """(by..., threshold, fpr, tpr) at each distinct score, from the highest."""
    at = df.groupBy(*by, F.col(score).alias("threshold")).agg(F.count_if(F.col(positive)).alias("_p"), F.count_if(~F.col(positive)).alias("_n"))
    above = running(at, list(by), ["threshold"], {"_fp": "_n", "_tp": "_p"}, descending=True)
    totals = at.groupBy(*by).agg(F.sum("_p").alias("_all_p"), F.sum("_n").alias("_all_n"))
    met = above.join(totals, list(by)) if by else above.crossJoin(F.broadcast(totals))  # totals is one row
    return met.select(*by, "threshold", F.try_divide(F.col("_fp") + F.col("_n"), "_all_n").alias("fpr"), F.try_divide(F.col("_tp") + F.col("_p"), "_all_p").alias("tpr"))


def mean_and_deviation(value: str) -> list[Column]:
    """Mean and population deviation, 0 of nothing."""
    return [F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("stddev")]


def median(value: str) -> Column:
    return F.percentile(value, 0.5)


def over_reruns(df: DataFrame) -> DataFrame:
    """(algo, s1, s2, median, mean) of (algo, rerun, s1, s2, dist)."""
    return df.groupBy("algo", "s1", "s2").agg(median("dist").alias("median"), F.avg("dist").alias("mean"))


def optimal_parameters(df: DataFrame, method: str, parameters: list[str], quality: str) -> DataFrame:
    """Of each method the parameters whose median quality is highest; the least of equally good ones."""
    medians = df.groupBy(method, *parameters).agg(median(quality).alias("median"))
    first = F.row_number().over(Window.partitionBy(method).orderBy(F.desc("median"), *parameters))
    return medians.withColumn("_n", first).where("_n = 1").drop("_n")


def summary_by(df: DataFrame, method: str, value: str, label: str) -> DataFrame:
    """Mean, sample deviation and the best and worst row's label of each method."""
    return df.groupBy(method).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"), F.max_by(label, F.struct(value, label)).alias("best"), F.min_by(label, F.struct(value, label)).alias("worst"))


def length_statistics(df: DataFrame, length: str) -> DataFrame:
    """One row: n, least, mean, deviation, most and sum."""
    return df.agg(F.count(length).alias("n"), F.min(length).alias("least"), *mean_and_deviation(length), F.max(length).alias("most"), F.sum(length).alias("total"))


def extreme_values(df: DataFrame, value: str, k: int = 5) -> DataFrame:
    """(which, place, value, n): the k lowest, highest and most frequent values."""
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    out = None
    for which, order in (("lowest", [F.asc("value")]), ("highest", [F.desc("value")]), ("frequent", [F.desc("n"), F.asc("value")])):
        top = counts.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order))).select(F.lit(which).alias("which"), "place", "value", "n")
        out = top if out is None else out.unionAll(top)
    return out


def exon_statistics(exons: DataFrame) -> DataFrame:
    """(tid, n_exons, total, shortest, longest) of (tid, start, end), ends included."""
    length = F.col("end") - F.col("start") + 1
    return exons.groupBy("tid").agg(F.count("*").alias("n_exons"), F.sum(length).alias("total"), F.min(length).alias("shortest"), F.max(length).alias("longest"))


def rank_matrix(df: DataFrame, dist: str) -> DataFrame:
    """(i, j, rank) both ways round, where the largest distance has rank 1."""
    ranks = ranked(df.withColumn("_d", -F.col(dist)), "_d", "i", "j")
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))  # so pairs are ranked once
    return ranks.select("rank", F.inline(both)).select("i", "j", "rank")


def of_largest(df: DataFrame, value: str, *by: str) -> DataFrame:
    """value over its group's largest, as share."""
    most = df.groupBy(*by).agg(F.max(value).alias("_most"))
    met = df.join(most, list(by)) if by else df.crossJoin(F.broadcast(most))  # most is one row
    return met.withColumn("share", F.try_divide(F.col(value), F.col("_most"))).drop("_most")
