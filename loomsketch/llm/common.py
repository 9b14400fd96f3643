"""What the operators share: written tables in the shared folder, and components of a graph."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes with more than one in so many of a graph's edges are few enough for a broadcast.
HUBS = 10_000
#: Words are runs of bytes other than ASCII white space, in Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only where Spark runs in one process,
    as in tests, a temporary one stands in where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: what follows reads files, so a lost executor costs no more than its tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    spark._jvm.System.gc()  # Spark drops the write's shuffle files once the driver's collector finds their plan unused
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that written() made and nothing reads any more."""
    spark = df.sparkSession
    for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unit_interval(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected edges (u, v): a row (node, component) for each node of an edge,
    where component is the smallest node that edges reach.

    Alternates large and small stars (each node points to the least neighbour it knows), so a chain of n nodes takes
    O(log n) rounds; every round is written to the shared folder. Self-loops and null ends are ignored; no edges
    give no rows. Least neighbours come from partial aggregates and reach the edges of hubs by a broadcast of bounded
    size, so a node with very many edges is no single task's.
    """
    edges = (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    now = written(edges, name)
    seal = _seal(now)
    while seal[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("many"))
        large = join_frequent(both, least, ["u"], seal[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many"))
        small = (
            join_frequent(large, least, ["u"], seal[0])
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = written(small, name)
        then = _seal(after)
        discard(now)
        discard(large)
        now = after
        if then == seal:
            break
        seal = then
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def join_frequent(rows: DataFrame, keyed: DataFrame, on: list[str], n: int) -> DataFrame:
    """rows joined with keyed, which has a row for each key and how many rows have it in many, which goes. Of n rows, the
    keys of more than n / HUBS go by a broadcast, and there are no more than 2 HUBS of them if rows are 2 n at most; so no
    more rows of one key meet in a task."""
    hubs = F.broadcast(keyed.where(F.col("many") * HUBS > n).drop("many"))
    others = keyed.where(F.col("many") * HUBS <= n).drop("many")
    return rows.join(hubs, on).unionAll(rows.join(hubs, on, "left_anti").join(others, on))


def _seal(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0
