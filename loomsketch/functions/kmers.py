"""k-mers of code sequences as integers, the first code least significant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, of) -> Column:
    """of(value), with value evaluated once a row however often of uses it."""
    return F.get(F.transform(F.array(value), lambda x: of(x)), F.lit(0))


def check_fits(size: int, k: int) -> None:
    if size**k >= 1 << 63:
        raise ValueError(f"{size}**{k} k-mers don't fit 63 bits")


def kmers(seq: Column, k: int, size: int) -> Column:
    """The n - k + 1 k-mers of a sequence over an alphabet of size codes; none if it is shorter."""
    check_fits(size, k)
    at = F.sequence(F.lit(0), F.size(seq) - k)

    def one(i: Column) -> Column:
        value = F.lit(0).cast("long")
        for j in range(k):
            value = value + F.get(seq, i + j).cast("long") * (size**j)
        return value

    return F.when(F.size(seq) >= k, F.transform(at, one)).otherwise(F.array().cast("array<bigint>"))


def exploded(df: DataFrame, k: int, size: int) -> DataFrame:
    """(seq_id, pos, kmer) of (seq_id, seq)."""
    return df.select("seq_id", F.posexplode(kmers(F.col("seq"), k, size)).alias("pos", "kmer"))


def with_occurrence(rows: DataFrame) -> DataFrame:
    """(seq_id, pos, kmer) with occ, how often the k-mer came before in the sequence."""
    before = Window.partitionBy("seq_id", "kmer").orderBy("pos")
    return rows.withColumn("occ", (F.row_number().over(before) - 1).cast("long"))


def occurrences(values: Column) -> Column:
    """For each element of an array, how many equal ones come before it; struct(kmer, occ). Elements are sorted with their places, so that equal ones
    are runs; a place's number in its run is its distance from where the run begins."""

    def of(placed: Column) -> Column:
        begins = F.transform(placed, lambda p, i: (i == 0) | (F.get(placed, i - 1)["kmer"] != p["kmer"]))
        # the run's first place, carried on from element to element
        return let(F.struct(placed.alias("placed"), _carried(begins).alias("first")), lambda x: F.transform(F.array_sort(F.zip_with(x["placed"], F.transform(x["first"], lambda f, i: i - f), lambda p, occ: F.struct(p["pos"].alias("pos"), p["kmer"].alias("kmer"), occ.cast("long").alias("occ")))), lambda r: F.struct(r["kmer"].alias("kmer"), r["occ"].alias("occ"))))

    return let(F.array_sort(F.transform(values, lambda x, i: F.struct(x.alias("kmer"), i.alias("pos")))), of)


def _carried(begins: Column) -> Column:
    """For each place the last place up to it that is true; the first is. Spans double: what no place of the last span gives is taken from the span before."""
    marks = F.transform(begins, lambda b, i: F.when(b, i).otherwise(F.lit(-1)))
    spans = F.filter(F.array(*(F.lit(1 << s) for s in range(31))), lambda s: s < F.size(begins))
    return F.aggregate(spans, marks, lambda m, s: F.transform(m, lambda x, i: F.greatest(x, F.coalesce(F.get(m, i - s), F.lit(-1)))))
