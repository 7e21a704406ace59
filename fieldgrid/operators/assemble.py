"""Completeness, mirror images and the assembly of channel-stacked samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .grid import mirrored

FIELDS = ("Mag_Bx", "Mag_By", "Magnetization", "Material", "Mu_avg")
KEYS = ["design_id", "phase_idx", "field"]


def expected_keys(designs: DataFrame, n_phases: int, fields=FIELDS) -> DataFrame:
    """design x phase x field, by exploding: narrow, no cross join."""
    d = designs.select("design_id").withColumn("phase_idx", F.explode(F.sequence(F.lit(0), F.lit(n_phases - 1))))
    return d.withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))


def missing_designs(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Designs that lack any expected key."""
    return expected.join(present, KEYS, "left_anti").select("design_id").distinct()


def expected_except_present(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.select(*KEYS).subtract(present.select(*KEYS))


def coverage(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected and present keys of each design, and its phases with any."""
    have = present.select(*KEYS).distinct().withColumn("there", F.lit(1))
    d = expected.join(have, KEYS, "left")
    return d.groupBy("design_id").agg(F.count("*").alias("n_expected"), F.count("there").alias("n_present"), F.countDistinct(F.when(F.col("there") == 1, F.col("phase_idx"))).alias("n_phases"))


def mirror(fields: DataFrame, n_phases: int) -> DataFrame:
    """fields and, for phases below n_phases, their images along the angle axis as phase_idx + n_phases. All fields are reversed alike; vector components keep their signs."""
    image = fields.where(F.col("phase_idx") < n_phases).withColumn("values", mirrored(F.col("values"), F.col("n_r"), F.col("n_a"))).withColumn("phase_idx", (F.col("phase_idx") + n_phases).cast("int"))
    return fields.unionByName(image)


def assemble(fields: DataFrame, n_phases: int, x_fields=("Mu_avg", "Magnetization"), y_fields=("Mag_Bx", "Mag_By"), strict: bool = True, partial: bool = False) -> DataFrame:
    """sample_ix, design_id, phase_idx, n_r, n_a, x, y: float channels stacked in the order of the lists, one shuffle.

    Strict: a sample raises that lacks a channel or has two grids for one, whose shapes
    differ, or that holds a null value. Else such samples are left out. Partial: a sample
    that lacks channels stays, with null in their places; what else is wrong with one is
    met as before. sample_ix is design-major.
    """
    wanted = [*x_fields, *y_fields]
    picks = [F.max(F.when(F.col("field") == f, F.col("values"))).alias(f"_{i}") for i, f in enumerate(wanted)]
    picks += [F.count_if(F.col("field") == f).alias(f"_n{i}") for i, f in enumerate(wanted)]
    d = fields.where(F.col("field").isin(wanted)).groupBy("design_id", "phase_idx").agg(F.max("n_r").alias("n_r"), F.max("n_a").alias("n_a"), F.min(F.struct("n_r", "n_a")).alias("_least"), *picks)
    cols = [F.col(f"_{i}") for i in range(len(wanted))]
    whole = (F.col("_least.n_r") == F.col("n_r")) & (F.col("_least.n_a") == F.col("n_a"))
    for i, c in enumerate(cols):
        one = (F.col(f"_n{i}") == 1) & c.isNotNull() & (F.size(c) == F.col("n_r") * F.col("n_a")) & F.forall(c, lambda v: v.isNotNull())
        whole = whole & ((F.col(f"_n{i}") == 0) | F.coalesce(one, F.lit(False)) if partial else one)
    whole = F.coalesce(whole, F.lit(False))
    if strict:
        d = d.where(F.assert_true(whole, F.concat(F.lit("incomplete sample of design "), F.col("design_id").cast("string"))).isNull())
    else:
        d = d.where(whole)
    stack = lambda cs: F.array(*[c.cast("array<float>") for c in cs])
    return d.select((F.col("design_id") * n_phases + F.col("phase_idx")).alias("sample_ix"), "design_id", "phase_idx", "n_r", "n_a", stack(cols[: len(x_fields)]).alias("x"), stack(cols[len(x_fields) :]).alias("y"))


def dense_ordinal(rows: DataFrame, order: list[str], out: str = "sample_ix", parts: int | None = None) -> DataFrame:
    """Numbers from 0 in the given order, without a window over all rows: rows are dealt by range, counted by part, and numbered within it.

    The dealt rows are written out first, as the bounds of ranges are sampled anew each
    time that they are asked for. The counts of the parts, a few hundred numbers, are the
    only window without a key.
    """
    spark = rows.sparkSession
    n, path = parts or int(spark.conf.get("spark.sql.shuffle.partitions")), scratch(spark, "dealt")
    rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return inside.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_row")).drop("_part", "_before", "_row")  # n rows
