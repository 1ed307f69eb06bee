"""Exceedance counts of replicates as their files arrive.

Counts add up, so a batch is counted alone and written under its number; a
batch that runs again after a failure replaces its own counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.nulls import exceedances


def count_arrivals(spark: SparkSession, source: str, schema: str, stat: str, thresholds: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Count every Parquet file below ``source`` once (columns of ``schema``,
    with replicate and ``stat``) and stop when all present are counted."""

    def add(batch: DataFrame, number: int) -> None:
        exceedances(batch, stat, thresholds).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(spark: SparkSession, out: str) -> DataFrame:
    """(threshold, replicate, n) of all batches so far."""
    return spark.read.parquet(out).groupBy("threshold", "replicate").agg(F.sum("n").alias("n"))
