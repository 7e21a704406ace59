"""Matrix files of a table that is one file."""

import pytest
from pyspark.sql import functions as F

from fieldgrid.plans import queries as q
from fieldgrid.sources import files


def test_matrices_are_written_by_many_tasks(spark, small, tmp_path):
    f = q.fields(spark, small).where("design_id < 8").coalesce(1)
    files.write_matrices(f, f"file://{tmp_path}/m")
    tasks = files.listing(spark, f"file://{tmp_path}/m").select(F.regexp_extract("path", r"/design_id=(\d+)/", 1).alias("d"), F.regexp_extract("path", r"part-(\d+)", 1).alias("task"))
    assert tasks.count() == 96 and tasks.select("task").distinct().count() > 1
    assert tasks.distinct().count() == 8  # a design is one task's
    got = files.read_matrices(spark, f"file://{tmp_path}/m")
    assert got.select("field", "design_id", "phase_idx", "values").exceptAll(f.select("field", "design_id", "phase_idx", "values")).count() == 0


def same(a, b):
    cols = ["field", "design_id", "phase_idx", "values"]
    return a.select(cols).exceptAll(b.select(cols)).count() == 0 == b.select(cols).exceptAll(a.select(cols)).count()


def test_tasks_make_local_files_themselves(spark, small, tmp_path, monkeypatch):
    """Spark's writer, which starts processes for each local file, is not used; the folders and texts are those that it makes, of odd names and keys that repeat or are null too."""
    from pyspark.sql import DataFrameWriter

    f = q.fields(spark, small).where("design_id < 4").drop("label")
    odd = F.when(F.col("phase_idx") == 0, "a b/c=1%é+").when(F.col("phase_idx") == 1, F.lit(None).cast("string")).otherwise(F.col("field"))
    f = f.unionByName(f.where("design_id = 2").withColumn("field", odd).withColumn("design_id", F.when(F.col("phase_idx") > 0, F.col("design_id"))))
    keys = ["field", "design_id", "phase_idx"]
    f.repartition(4, "design_id").select(*keys, files.matrix_text(F.col("values"), F.col("n_r"), F.col("n_a")).alias("value")).write.partitionBy(*keys).text(f"file://{tmp_path}/spark")
    monkeypatch.setattr(DataFrameWriter, "text", None)
    files.write_matrices(f, f"file://{tmp_path}/own")

    def texts(name):
        root = tmp_path / name
        found = [p for p in root.rglob("*") if p.is_file() and p.name[0] not in "._"]
        return sorted((str(p.parent.relative_to(root)), sorted(p.read_text().split("\n"))) for p in found)

    assert texts("own") == texts("spark") and len(texts("own")) > 48
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []
    own, made = (files.read_matrices(spark, f"file://{tmp_path}/{x}") for x in ("own", "spark"))
    assert own.count() == made.count() == len(texts("own")) and own.where("field = 'a b/c=1%é+' AND design_id IS NULL").count() == own.where("field IS NULL AND design_id = 2").count() == 1
    with pytest.raises(FileExistsError):
        files.write_matrices(f, f"file://{tmp_path}/own")


def test_a_failed_write_leaves_nothing(spark, small, tmp_path):
    f = q.fields(spark, small).withColumn("n_r", F.when(F.col("design_id") == 7, F.raise_error("spoilt").cast("int")).otherwise(F.col("n_r")))
    with pytest.raises(Exception, match="spoilt"):
        files.write_matrices(f, f"file://{tmp_path}/m")
    assert list(tmp_path.iterdir()) == []


def test_no_grids_and_other_stores(spark, small, tmp_path):
    f = q.fields(spark, small).where("design_id < 2").drop("label")
    files.write_matrices(f.limit(0), f"file://{tmp_path}/none")
    assert files.read_matrices(spark, f"file://{tmp_path}/none").count() == 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.matrices.link./m", f"file://{tmp_path}")
    files.write_matrices(f, "viewfs://matrices/m/far")
    assert same(files.read_matrices(spark, "viewfs://matrices/m/far"), f)
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    files.listing(spark, "viewfs://matrices/m/far")
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


@pytest.mark.parametrize("codec", ["none", "gzip"])
def test_tasks_list_and_read_local_folders(spark, small, tmp_path, codec):
    """No list of all files is made in the driver; of Spark's own folders neither, packed or not."""
    f, keys = q.fields(spark, small).where("design_id < 6").drop("label"), ["field", "design_id", "phase_idx"]
    f.select(*keys, files.matrix_text(F.col("values"), F.col("n_r"), F.col("n_a")).alias("value")).write.partitionBy(*keys).option("compression", codec).text(f"file://{tmp_path}/spark")
    got = files.read_matrices(spark, f"file://{tmp_path}/spark")
    assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
    assert same(got, f) and got.count() == 72
    (tmp_path / "spark" / "Mu_avg_9_p1.csv").write_text("1,2\n3,4")
    mixed = files.read_matrices(spark, f"file://{tmp_path}/spark")  # other layouts are Spark's to read
    assert "FileScan" in mixed._jdf.queryExecution().executedPlan().toString()
