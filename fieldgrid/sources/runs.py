"""Runs that generate what is missing, and a ledger of what became of each design."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LEDGER = "design_id long, run int, n_expected int, n_present int, n_bad int, state string"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All entries: one for each design that a run took up. Entries are added, never changed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger") if there else spark.createDataFrame([], LEDGER)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Each design's latest entry, and attempts, the number of its entries."""
    last = ledger(spark, path).groupBy("design_id").agg(F.max_by(F.struct("run", "n_expected", "n_present", "n_bad", "state"), "run").alias("e"), F.count("*").cast("int").alias("attempts"))
    return last.select("design_id", "e.*", "attempts")


def worklist(designs: DataFrame, path: str) -> DataFrame:
    """The designs that no run has made whole, or given up."""
    ended = latest(designs.sparkSession, path).where("state IN ('ok', 'failed')")
    return designs.join(ended, "design_id", "left_anti")


def execute(designs: DataFrame, generate: Callable[[DataFrame], DataFrame], path: str, n_phases: int, fields: tuple, max_attempts: int = 2) -> dict[str, int]:
    """One run: generates the worklist's fields, writes them, and adds what became of each design to the ledger. Returns the observed numbers of designs by state, and of grids that were written and bad.

    generate takes designs and gives fields (design_id, phase_idx, field, n_r, n_a,
    values), from which some may be missing; a grid with a null, NaN or infinite value or
    of a wrong size is bad, and a key that is there twice counts once. A design is `ok`
    if each expected key has a good grid, else `failed` at max_attempts and `pending`
    before. Each run has folders of its own, of the next number in the ledger. A run that
    ended before its entries were written is repeated under its number, and replaces
    what it left; designs that are `ok` are never generated again.
    """
    spark = designs.sparkSession
    number = (ledger(spark, path).agg(F.max("run")).collect()[0][0] or 0) + 1
    work, at = worklist(designs.select(*designs.columns), path), f"{path}/work/run={number}"
    work.write.mode("overwrite").parquet(at)
    work = spark.read.schema(work.schema).parquet(at)
    wrong = (F.size("values") != F.col("n_r") * F.col("n_a")) | F.exists("values", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    made = generate(work).select("design_id", "phase_idx", "field", "n_r", "n_a", "values", F.coalesce(wrong, F.lit(True)).alias("bad"))
    grids, ends = Observation(), Observation()
    made.observe(grids, F.count("*").alias("grids"), F.count_if("bad").alias("bad_grids")).write.mode("overwrite").parquet(f"{path}/fields/run={number}")
    # from here on keys alone are read
    keys = spark.read.parquet(f"{path}/fields/run={number}").where(F.col("field").isin(list(fields)) & F.col("phase_idx").between(0, n_phases - 1))
    there = keys.groupBy("design_id").agg(F.count_distinct(F.when(~F.col("bad"), F.struct("phase_idx", "field"))).cast("int").alias("n_present"), F.count_if("bad").cast("int").alias("n_bad"))
    before = latest(spark, path).select("design_id", "attempts")
    n = n_phases * len(fields)
    d = work.select("design_id").join(there, "design_id", "left").join(before, "design_id", "left").fillna(0, ["n_present", "n_bad", "attempts"])
    state = F.when(F.col("n_present") == n, "ok").when(F.col("attempts") + 1 >= max_attempts, "failed").otherwise("pending")
    entries = d.select("design_id", F.lit(number).alias("run"), F.lit(n).alias("n_expected"), "n_present", "n_bad", state.alias("state"))
    entries.observe(ends, *[F.count_if(F.col("state") == s).alias(s) for s in ("ok", "pending", "failed")]).write.mode("overwrite").parquet(f"{path}/ledger/entries={number}")
    return {k: int(v) for o in (ends, grids) for k, v in o.get.items()}


def whole_fields(spark: SparkSession, path: str) -> DataFrame:
    """The fields of the designs that are ok, each from the run that made it so; other runs' folders are not read where the planner can tell."""
    ok = latest(spark, path).where("state = 'ok'").select("design_id", "run")
    every = spark.read.option("basePath", f"{path}/fields").parquet(f"{path}/fields")
    return every.where("NOT bad").join(ok, ["design_id", "run"], "left_semi").dropDuplicates(["design_id", "phase_idx", "field"]).select("design_id", "phase_idx", "field", "n_r", "n_a", "values")
