"""Corpora: a table's text column, or text files by one or many paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select("text")


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """A row for each line of all files; partitions stand in for the tasks of a file each."""
    return spark.read.text(list(paths)).select(F.col("value").alias("text"))


def shuffled(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Texts as single lines in random order; the sort deals by range, so no task holds all."""
    return docs.select(F.translate("text", "\n", " ").alias("text")).orderBy(F.rand(seed))


def shuffled_parts(docs: DataFrame, folder: str, rows: int, seed: int = 0) -> None:
    """The corpus in random order, in files of `rows` lines at most."""
    shuffled(docs, seed).select(F.col("text").alias("value")).write.option("maxRecordsPerFile", rows).text(folder)
