"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

toxicity      rows that the classifier rejects go
line_dedup    lines that nearly repeat go from the texts; n_chars follows the text
near_dedup    one document of each group of near-duplicates (five-word shingles, similarity 0.8) stays
mixing        rows come as often as the mix to target weights takes them
packing       documents become pieces of training sequences: a row for each piece, with its ids

SQL can't express the stages; tests hold them against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsketch.llm import forest, fuzzy_lines, mixing, packing, toxicity
from loomsketch.llm.common import discard, written

NEAR_WORDS, NEAR_PERCENT = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = fuzzy_lines.deduplicated(docs)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = forest.grouped_documents(docs, NEAR_PERCENT, NEAR_WORDS)
    kept = groups.where("kept").select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.stays), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", remove_lines),
    ("near_dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of documents; what each stage but the last returns is written and read again, and deleted once the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
