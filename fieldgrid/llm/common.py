"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that separate words and that are stripped from lines: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir or the context names it; where neither does, a temporary one if all runs on this machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        context.setCheckpointDir(found)
    return found


#: Folders that were named while a passing() lasts.
_named: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for own in _named:
        own.append(path)
    return path


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Deletes the tables that are written meanwhile, at its end; but for those whose paths are appended to the list that it gives."""
    kept: list[str] = []
    _named.append([])
    try:
        yield kept
    finally:
        for path in set(_named.pop()) - set(kept):
            discard(spark, path)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(df, as written to the shared folder and read back; its path). The shuffle files that it took go at once, as what is written no longer needs them."""
    spark = df.sparkSession
    path, clean = new_folder(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage in a way that outlives lost executors, and tells the planner
    the table's size, so that it broadcasts a small one and shuffles a large one.
    """
    return stored(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of stored() when all that comes from it is written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts of at most 8 MB; only where the session has Spark's default, 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, "8m")


def byte_slices(batch, name: str, most: int = 2 << 20):
    """Parts of an Arrow batch with about `most` bytes in a column of texts, a row at least."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(name))), 0).to_numpy().astype("int64") + 64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(id_column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(id_column.cast("string").cast("binary")) % n


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, rows_per_bucket: int = 50_000, bucket_by: str | None = None) -> DataFrame:
    """Adds out: the sum of value over the rows of the same keys that come before, in an order fixed by the data.

    A key may hold any share of all rows, so no window runs over a whole key: rows are
    dealt to buckets by a hash of the order columns; buckets are summed, the few
    bucket sums get running totals, and rows only look back within their bucket.
    """
    spark = df.sparkSession
    n = max(16, min(1 << 20, -(-df.count() // rows_per_bucket) * 16))
    bucket = F.pmod(F.xxhash64(*[bucket_by] if bucket_by else order), F.lit(n))
    dealt = df.withColumn("_bucket", bucket)
    sums = dealt.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    # the bucket sums of one key number at most n
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    before = materialize(before.withColumn("_before", F.coalesce("_before", F.lit(0))), "totals")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a, b = dealt.withColumn("_inside", inside).alias("a"), before.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_bucket"]]
    return a.join(b, on, "left").select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._inside") + F.coalesce(F.col("b._before"), F.lit(0))).cast("long").alias(out))


def give_back() -> None:
    """Returns to the system what this process has freed."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def tidy(run):
    """run over batches; then what it used is given back, as the Python worker lives on beside those of later stages."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied
