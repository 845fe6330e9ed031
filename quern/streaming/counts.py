"""Token counts over files as they arrive: an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.count import alpha


def token_counts(spark: SparkSession, folder: str, state: str, out: str) -> DataFrame:
    """Counts the files that came since the last call and returns (token, cnt) over all so far.

    Each batch is counted by itself and written under its own number, so that a batch that runs twice
    overwrites what it wrote; the state has only the list of files seen.
    """
    lines = spark.readStream.schema("value string").text(folder).select(F.col("value").alias("text"))

    def put(batch: DataFrame, number: int) -> None:
        alpha(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    lines.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("token string, cnt long, batch int").parquet(out).groupBy("token").agg(F.sum("cnt").alias("cnt"))
