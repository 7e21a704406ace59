"""Reading and writing designs, grids and samples."""

from __future__ import annotations

import contextlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import design
from .scratch import scratch  # noqa: F401

NAME = r"([A-Za-z_]+?)_(\d+)_p(\d+)\.csv"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_designs(designs: DataFrame, path: str) -> None:
    """CSV whose header has units: `name [unit]`. design_id comes first."""
    designs.select("design_id", *[F.col(x).alias(design.header(x)) for x in design.UNITS]).write.csv(path, header=True)


def read_designs(spark: SparkSession, path: str) -> DataFrame:
    """The units in the header go to the columns' metadata."""
    import copy

    schema = copy.deepcopy(design.SCHEMA)
    for f in schema.fields[1:]:
        f.name = design.header(f.name)
    schema.names = [f.name for f in schema.fields]
    raw = spark.read.csv(path, header=True, schema=schema)
    parts = [re.fullmatch(r"(.*?)(?: \[(.*)\])?", c) for c in raw.columns]
    return raw.select(*[F.col(f"`{c}`").alias(m[1], metadata={"unit": m[2]} if m[2] else {}) for c, m in zip(raw.columns, parts)])


def file_name(field: Column, design_id: Column, phase_idx: Column) -> Column:
    return F.format_string("%s_%d_p%d.csv", field, design_id, phase_idx)


def parse_name(name: Column) -> dict[str, Column]:
    whole = rf"(?:^|/){NAME}$"
    return {"field": F.regexp_extract(name, whole, 1), "design_id": F.regexp_extract(name, whole, 2).try_cast("long"), "phase_idx": F.regexp_extract(name, whole, 3).try_cast("int")}


def matrix_text(values: Column, n_r: Column, n_a: Column) -> Column:
    """n_r lines of n_a comma-separated numbers."""
    rows = F.transform(F.sequence(F.lit(0), n_r - 1), lambda i: F.array_join(F.slice(values, i * n_a + 1, n_a), ","))
    return F.array_join(rows, "\n")


def parsed(text: DataFrame, column: str = "value") -> DataFrame:
    """text with n_r, n_a, values, and reason: null if the text is a whole matrix of finite numbers, else why it isn't."""
    lines = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), "\r?\n"), lambda x: F.trim(x) != "")
    d = text.withColumn("_rows", F.transform(lines, lambda x: F.split(x, ",")))
    d = d.withColumns({"n_r": F.size("_rows"), "n_a": F.coalesce(F.size(F.try_element_at("_rows", F.lit(1))), F.lit(0)), "values": F.transform(F.flatten("_rows"), lambda x: F.trim(x).try_cast("double"))})
    reason = (
        F.when(F.col("n_r") == 0, "empty")
        .when(F.exists("_rows", lambda r: F.size(r) != F.col("n_a")), "ragged")
        .when(F.exists("values", lambda v: v.isNull()), "not a number")
        .when(F.exists("values", lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), "not finite")
    )
    return d.withColumn("reason", reason).drop("_rows")


def write_matrices(fields: DataFrame, path: str) -> None:
    """A text file for each grid; its keys are the folders' names. Making files takes far longer than their texts, so grids are dealt to tasks by design, however few files they come from; a design's folders are then one task's.

    In a folder of a file system that all tasks mount (file:) they make the files
    themselves, in a folder beside it that gets its name when all are there: Hadoop's own
    local files take a process or more each, for their permissions. Any other store is
    written by Spark.
    """
    spark, keys = fields.sparkSession, ["field", "design_id", "phase_idx"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = fields.repartition(parts, "design_id").select(*keys, matrix_text(F.col("values"), F.col("n_r"), F.col("n_a")).alias("value"))
    hadoop, at = spark.sparkContext._jvm.org.apache.hadoop.fs, _qualified(spark, path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if at.toUri().getScheme() != "file":
        texts.write.partitionBy(*keys).text(path)
        return
    if store.exists(at):
        raise FileExistsError(path)
    made = hadoop.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")
    store.mkdirs(made)
    try:
        named = texts.select(*[F.col(k).cast("string") for k in keys], F.col("value").cast("binary")).sortWithinPartitions(*keys)
        named.mapInArrow(_files_of(made.toUri().getPath(), keys), "files long").agg(F.sum("files")).collect()
        if not store.rename(made, at):
            raise OSError(f"{made} could not get the name {path}")
    except BaseException:
        store.delete(made, True)
        raise


#: What Spark writes as % and two digits in folders' names, and the name of a null or empty value.
ESCAPED, NO_VALUE = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]"), "__HIVE_DEFAULT_PARTITION__"


def _files_of(root: str, keys: list[str]):
    """Writes the texts of rows that are sorted by the keys, as strings, to a file for each key under root, and counts the files. One that is written again, by another attempt, is replaced whole."""

    def run(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        name, own = f"part-{task.partitionId():05d}.txt", f".part-{task.taskAttemptId()}"
        last, lines = None, []

        def done():
            at = "/".join([root, *[f"{k}={ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', v) if v else NO_VALUE}" for k, v in zip(keys, last)]])
            try:
                os.mkdir(at)
            except FileNotFoundError:
                os.makedirs(at, exist_ok=True)
            except FileExistsError:
                pass
            with open(f"{at}/{own}", "wb") as f:
                f.write(b"\n".join([*lines, b""]))
            os.replace(f"{at}/{own}", f"{at}/{name}")

        n = 0
        for batch in batches:
            for *key, value in zip(*[batch.column(batch.schema.names.index(c)).to_pylist() for c in (*keys, "value")]):
                if key != last:
                    if lines:
                        done()
                    last, lines, n = key, [], n + 1
                lines.append(value or b"")
        if lines:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    return run


def _qualified(spark: SparkSession, path: str):
    """path with its store's scheme, as Hadoop's Path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at)


def _found(spark: SparkSession, at, names: str):
    """Hadoop's array of what has such names in a folder."""
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, names)) or []


def _keyed(spark: SparkSession, at) -> bool:
    """Whether the folders are as write_matrices makes them: nothing but fields' above, and by the first of each key."""
    if len(_found(spark, at, "*")) - len(_found(spark, at, "[._]*")) != len(_found(spark, at, "field=*")):
        return False
    for key in ("field", "design_id", "phase_idx"):
        found = _found(spark, at, f"{key}=*")
        if not found:
            return False
        at = found[0].getPath()
    return True


@contextlib.contextmanager
def _few_listers(spark: SparkSession):
    """While it lasts, folders are listed by a few tasks for each core, not by one a folder."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """Grids of matrix files, keys from folders if there are any, else from the files' names.

    Folders as write_matrices makes them, on a file system that all tasks mount (file:),
    are listed and read in tasks, by design: Spark's reader would list every file in the
    driver first.
    """
    at = _qualified(spark, path)
    if at.toUri().getScheme() == "file" and _keyed(spark, at):
        keys = ["field", "design_id", "phase_idx"]
        fields = spark.createDataFrame([(f.getPath().getName(),) for f in _found(spark, at, "field=*")], "folder string")
        designs = fields.repartition("folder").mapInArrow(_folders_in(at.toUri().getPath()), "folder string")
        files = designs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder").mapInArrow(_texts_of(at.toUri().getPath()), "field string, design_id string, phase_idx string, value string")
        raw = files.select(*keys, "value")
    else:
        with _few_listers(spark):
            raw = spark.read.text(path, wholetext=True)
        if "design_id" not in raw.columns:
            raw = raw.withColumns(parse_name(F.col("_metadata.file_path")))
    good = parsed(raw).where("reason IS NULL")
    return good.select(F.col("design_id").cast("long").alias("design_id"), F.col("phase_idx").cast("int").alias("phase_idx"), "field", "n_r", "n_a", "values")


def _shown(folder: str) -> list:
    """The names in a folder, in order, but those that Spark takes for hidden."""
    import os

    return sorted(x for x in os.listdir(folder) if x[0] not in "._")


def _folders_in(root: str):
    """The folders of designs in the rows' folders of fields."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [f"{folder}/{x}" for x in _shown(f"{root}/{folder}")]
                for lo in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(found[lo : lo + 10_000], pa.string())], names=["folder"])

    return run


def _texts_of(root: str):
    """The keys and whole texts of the files in the rows' folders of designs."""

    def value_of(name):
        value = re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), name.split("=", 1)[1])
        return None if value == NO_VALUE else value

    def run(batches):
        import pyarrow as pa

        names = ["field", "design_id", "phase_idx", "value"]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)
        rows, held = [], 0
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for phase in _shown(f"{root}/{folder}"):
                    keys = [value_of(x) for x in (*folder.split("/"), phase)]
                    for name in _shown(f"{root}/{folder}/{phase}"):
                        with pa.input_stream(f"{root}/{folder}/{phase}/{name}") as f:  # as the name says, of packed ones too
                            text = f.read().decode("utf-8", "replace")
                        rows.append((*keys, text))
                        held += len(text)
                        if held > 4 << 20 or len(rows) >= 10_000:
                            yield made(rows)
                            rows, held = [], 0
        if rows:
            yield made(rows)

    return run


def write_fields(fields: DataFrame, path: str) -> None:
    """Grids as parquet, a folder for each field; a file holds many grids, so it suits any number of them."""
    fields.select("design_id", "phase_idx", "n_r", "n_a", "values", "field").write.partitionBy("field").parquet(path)


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("design_id", "phase_idx", "field", "n_r", "n_a", "values")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The files under a folder, by name alone: contents are not read."""
    with _few_listers(spark):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


def write_samples(samples: DataFrame, path: str) -> None:
    samples.sortWithinPartitions("sample_ix").write.parquet(path)


def write_bucketed(samples: DataFrame, path: str, name: str, buckets: int, by: str = "sample_ix") -> DataFrame:
    """Samples as a table of the catalog with files under path, dealt to buckets by the key and sorted in each. Two that have as many buckets are joined by it without a shuffle, as often as is asked; an older table of the name is replaced.

    Rows are dealt before they are written, so a bucket is one file: the join then needs no sort either where a task reads a bucket.
    """
    samples.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
    return samples.sparkSession.table(name)


def write_mirrored(image: DataFrame, path: str) -> None:
    """Adds partitions; a second run overwrites its own alone."""
    image.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("phase_idx").parquet(path)
