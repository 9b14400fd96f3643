"""How long methods take, by their sketches and distances: a run's timing table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import pairs
from ..sources.shared import written
from .engine import Parameters, distance_column, sketched

SCHEMA = "algo string, sketches long, pairs long, sketch_ms double, dist_ms double, total_ms double"


def measured(sequences: DataFrame, methods: list[Parameters]) -> DataFrame:
    """(algo, sketches, pairs, sketch_ms, dist_ms, total_ms): of each method the milliseconds of wall clock a sketch, k-mers included, and a pair's
    distance take on the mean, over sequences(seq_id, group, seq) and the pairs of its groups. Sketches are written before the distances are timed; how
    many rows went through is observed as they go. A method's parameters are run one after the other."""
    rows = []
    for p in methods:
        made, met = Observation(f"{p.method} sketches"), Observation(f"{p.method} pairs")
        began = time.perf_counter()
        own = written(sketched(sequences.select("seq_id", "group", "seq"), p).select("seq_id", "group", "sketch").observe(made, F.count("*").alias("n")), "timing")
        middle = time.perf_counter()
        distance = distance_column(F.col("sketch_i"), F.col("sketch_j"), p).alias("dist")
        pairs.in_group(own, "seq_id", "group", ["sketch"]).select("i", "j", distance).observe(met, F.count("dist").alias("n")).write.format("noop").mode("overwrite").save()
        ended = time.perf_counter()
        sketches, distances = made.get["n"], met.get["n"]
        sketch_ms, dist_ms = 1000 * (middle - began) / max(1, sketches), 1000 * (ended - middle) / max(1, distances)
        rows.append((p.method, sketches, distances, sketch_ms, dist_ms, sketch_ms + dist_ms))
    return sequences.sparkSession.createDataFrame(rows, SCHEMA)


def relative(timing: DataFrame, to: str = "ED") -> DataFrame:
    """timing with each method's time as a share of another's, null if that isn't there."""
    base = timing.where(F.col("algo") == to).agg(F.max("total_ms").alias("_base"))  # one row
    return timing.crossJoin(F.broadcast(base)).withColumn("relative", F.try_divide("total_ms", "_base")).drop("_base")
