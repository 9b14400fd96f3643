"""The driver's tables as sequences and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The event types in the order of their codes.
EVENTS = ("click", "error", "purchase", "signup", "view")


def event_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, ts, event_id, code): each user's events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").alias("seq_id"), "ts", "event_id", code_of(F.col("event_type")).alias("code"))


def code_of(event_type: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, EVENTS)), event_type) - 1).cast("int")


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq): the codes of each user's events by time."""
    rows = event_positions(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "code")))
    return rows.groupBy("seq_id").agg(F.transform(ordered, lambda x: x.code).alias("seq"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, label, v)."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(F.col("vec_id").alias("seq_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def letter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, letters): the ASCII letters of each document in upper case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("seq_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("letters"))
