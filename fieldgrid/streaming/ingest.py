"""Grids that arrive as files over time, and the designs that are complete so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def completeness(stream: DataFrame, n_expected: int) -> DataFrame:
    """design_id, n_present, complete of a stream of keys. State holds one entry a key, bounded by the dataset, so there is no watermark."""
    keys = stream.select("design_id", "phase_idx", "field").dropDuplicates(["design_id", "phase_idx", "field"])
    return keys.groupBy("design_id").agg(F.count("*").alias("n_present")).withColumn("complete", F.col("n_present") >= n_expected)


def drain(spark: SparkSession, path: str, schema, n_expected: int, out: str, checkpoint: str) -> DataFrame:
    """Reads what has arrived so far under path and returns the latest state of each design from the sink at out."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        # a repeated batch replaces its own folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = completeness(stream, n_expected).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    latest = spark.read.parquet(out).groupBy("design_id").agg(F.max_by(F.struct("n_present", "complete"), "batch").alias("s"))
    return latest.select("design_id", "s.n_present", "s.complete")
