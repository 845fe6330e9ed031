"""Shared pieces: stored intermediate tables, connected components, text primitives."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow.fs
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything between runs of it is a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made by this process, for cleanup().
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder that every executor reaches, below spark.checkpoint.dir.

    Where that is unset a local session gets a temporary folder; a cluster raises, as executors would
    each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    MADE.append(f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}")
    return MADE[-1]


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*stored: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for df in stored:
        if files := df.inputFiles():
            remove(df.sparkSession, files[0].rsplit("/", 1)[0])


def open_file(path: str, mode: str):
    """A file of the shared folder, from within a task; mode r or w."""
    fs, at = pa.fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))
    if mode == "r":
        return fs.open_input_stream(at)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(at)


def cleanup(spark: SparkSession) -> None:
    """Removes every stored table of this process; results that weren't written or collected can't be read afterwards."""
    while MADE:
        remove(spark, MADE.pop())


#: Removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    Nothing reads the write's own shuffles afterwards, so their files go as soon as it ends.
    """
    spark = df.sparkSession
    at, before = shared_dir(spark), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(at)


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, root): root is the smallest node that links reach.

    Alternates large-star and small-star steps; each is an aggregate that keeps one minimum
    for each node and a join back, so that no neighbour list is ever gathered. A round's
    result is written to the shared folder. Nodes without an edge don't appear.
    """
    e = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are stored, so that both sides of a join are exchanges, which Spark splits where a node has many links
        low = store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = store(both.filter("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct())
        least = store(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least.hint("merge"), "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, store(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        forget(old, low, large, least)
        seen = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
