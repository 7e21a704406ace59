"""Good and rejected grids as tables, written in one pass over their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .files import parsed

KEYS = ("field", "design_id", "phase_idx")
REASONS = ("no key", "empty", "ragged", "not a number", "not finite", "wrong size")


def write(text: DataFrame, path: str, keys: tuple = KEYS, shape: tuple[int, int] | None = None, column: str = "value") -> dict[str, int]:
    """Writes texts of matrices (keys, column) under path, split by outcome; returns the number of rows by reason, `good` for none.

    A row is rejected for the first of REASONS that holds: a null key, no line, lines of
    unequal length, a cell that isn't a number, NaN or infinity, a size other than shape
    (if given). Rejected rows keep their text, good ones their values. The texts are read
    and parsed once; the counts are observed on the way. Rows that are good but for a key
    that others have too are told from the keys alone, after, and belong to the rejected:
    which of them is right can't be told. A second run replaces the first.
    """
    d = parsed(text.select(*keys, F.col(column).alias("value")))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    size = F.lit(False) if shape is None else ((F.col("n_r") != shape[0]) | (F.col("n_a") != shape[1]))
    reason = F.when(no_key, "no key").otherwise(F.coalesce("reason", F.when(size, "wrong size")))
    d = d.withColumn("reason", reason).withColumns({"outcome": F.when(F.col("reason").isNull(), "good").otherwise("rejected"), "value": F.when(F.col("reason").isNotNull(), F.col("value")), "values": F.when(F.col("reason").isNull(), F.col("values"))})
    seen = Observation()
    counts = [F.count_if(F.col("reason").isNull()).alias("good"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS]]
    d.observe(seen, *counts).write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/grids")
    out = {k: int(v) for k, v in seen.get.items()}
    spark = text.sparkSession
    d.limit(0).write.mode("overwrite").parquet(f"{path}/columns")  # as a table of no rows has no file that names them
    grids(spark, path).where("outcome = 'good'").groupBy(*keys).count().where("count > 1").select(*keys).write.mode("overwrite").parquet(f"{path}/repeated")
    return out


def grids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/grids")


def tables(spark: SparkSession, path: str, keys: tuple = KEYS) -> tuple[DataFrame, DataFrame]:
    """(good: keys, n_r, n_a, values; rejected: keys, n_r, n_a, value, reason) of what write() left. The reason of rows that share a key is `duplicate key`; they keep their text as one of numbers."""
    from .files import matrix_text

    rows, repeated = grids(spark, path), spark.read.parquet(f"{path}/repeated")
    own = rows.where("outcome = 'good'")
    good = own.join(repeated, list(keys), "left_anti").select(*keys, "n_r", "n_a", "values")
    twice = own.join(repeated, list(keys), "left_semi").select(*keys, "n_r", "n_a", matrix_text(F.col("values"), F.col("n_r"), F.col("n_a")).alias("value"), F.lit("duplicate key").alias("reason"))
    return good, rows.where("outcome = 'rejected'").select(*keys, "n_r", "n_a", "value", "reason").unionByName(twice)
