"""Exon lists in JSON: {transcript: [{"start": n, "end": n}, ...]}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "map<string, array<struct<start: int, end: int>>>"


def read_exons(spark: SparkSession, path: str) -> DataFrame:
    """(tid, place, start, end) of a file or folder; each file is one JSON object."""
    whole = spark.read.option("wholetext", True).text(path)
    return parsed(whole, "value")


def parsed(df: DataFrame, column: str) -> DataFrame:
    entries = df.select(F.explode(F.from_json(column, SCHEMA)).alias("tid", "exons"))
    return entries.select("tid", F.posexplode("exons").alias("place", "exon")).select("tid", "place", "exon.start", "exon.end")


def of_sequences(sequences: DataFrame, exons: DataFrame) -> DataFrame:
    """Sequences (comment, ...) with the exons of the transcript that their header names, where there are any."""
    from .fasta import header_fields

    return sequences.withColumn("tid", F.element_at(header_fields(F.col("comment")), F.lit("tid"))).join(exons, "tid", "left")
