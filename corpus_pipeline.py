"""From raw documents to a training mix: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last return the
columns of documents.

Defined cases, in every stage: a document is its doc_id and text together, so rows without an id, or
with the same one, are told apart by their texts; rows equal in both are one document. Null and
empty texts are no toxic, held or repeated ones; as near-duplicates they are one group. Further
columns are kept whatever they are called. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, linededup, mixing, simhash, toxicity
from quern.llm.common import store, table

REJECT = 0.3


def _free(docs: DataFrame, name: str) -> str:
    """name, lengthened until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the score that rejects; learnt from the labels of those outside the held-out remainder."""
    score = toxicity.scoring(*toxicity.trained(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score("text") < REJECT)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that stand elsewhere; n_chars follows the text."""
    lost = _free(docs, "_lines")
    out = linededup.dedup(docs, lost=lost)
    return out.withColumn("n_chars", F.when(F.col(lost) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by their fingerprints or at 0.8 of their five-word shingles the one with the smallest id (null last), then hash of the text."""
    k, t = _free(docs, "_k"), _free(docs, "_t")
    kept = simhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias(f"{k}2"), F.col("th").alias(f"{t}2")).distinct()
    keyed = docs.withColumn(k, F.col("doc_id").cast("long")).withColumn(t, F.xxhash64(F.col("text").cast("string")))
    same = F.col(k).eqNullSafe(F.col(f"{k}2")) & (F.col(t) == F.col(f"{t}2"))
    return keyed.join(kept, same, "left_semi").dropDuplicates([k, t]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    k = _free(docs, "_k")
    keyed = docs.withColumn(k, F.xxhash64("doc_id", "text"))
    held = decontaminate.held(keyed.select(F.col(k).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(k)).distinct()
    return keyed.join(held, k, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many of its words the mix takes from each document."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_sources),
]
ORACLE_SQL = None  # classifiers and hashes that SQL can't express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
