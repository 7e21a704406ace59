"""Quarantine of grids and the ledger of runs."""

from pyspark.sql import functions as F

from fieldgrid.operators import assemble
from fieldgrid.sources import quarantine, runs

FIELDS = ("Mu_avg", "Mag_Bx")


def test_quarantine_splits_rows_in_one_pass(spark, tmp_path):
    text = {
        1: "1,2\n3,4", 2: "1,2\n3", 3: "", 4: None, 5: "1,x\n3,4", 6: "1,nan\n3,4", 7: "1,2\n3,-Infinity", 8: "1,2,3\n4,5,6", 9: "5,6\n7,8", None: "1,2\n3,4",
    }
    rows = [("Mu_avg", k, 0, v, "extra") for k, v in text.items()] + [("Mu_avg", 9, 0, "5,6\n7,8", "again"), ("Mu_avg", 1, 1, "9,9\n9,9", "other key")]
    df = spark.createDataFrame(rows, "field string, design_id long, phase_idx int, value string, outcome string")
    path = f"file://{tmp_path}/q"
    for _ in range(2):  # a second run replaces the first
        counts = quarantine.write(df, path, shape=(2, 2))
    assert counts == {"good": 4, "no key": 1, "empty": 2, "ragged": 1, "not a number": 1, "not finite": 2, "wrong size": 1}
    good, rejected = quarantine.tables(spark, path)
    assert sorted((r.design_id, r.phase_idx, r["values"]) for r in good.collect()) == [(1, 0, [1, 2, 3, 4]), (1, 1, [9, 9, 9, 9])]
    got = sorted(((r.design_id or 0), r.reason) for r in rejected.collect())
    assert got == [(0, "no key"), (2, "ragged"), (3, "empty"), (4, "empty"), (5, "not a number"), (6, "not finite"), (7, "not finite"), (8, "wrong size"), (9, "duplicate key"), (9, "duplicate key")]
    assert {r.design_id: r.value for r in rejected.collect()}[2] == "1,2\n3"
    assert sum(quarantine.write(df.limit(0), path).values()) == 0 and quarantine.tables(spark, path)[0].count() == 0


def maker(spark, lost=(), spoilt=(), asked=None):
    def generate(designs):
        if asked is not None:
            asked.append(sorted(r.design_id for r in designs.collect()))
        d = assemble.expected_keys(designs, 2, FIELDS).where(~F.col("design_id").isin(list(lost)) | (F.col("phase_idx") == 0))
        v = F.when(F.col("design_id").isin(list(spoilt)), F.lit(float("nan"))).otherwise(F.col("design_id").cast("double"))
        return d.select("*", F.lit(1).alias("n_r"), F.lit(2).alias("n_a"), F.array(v, v).alias("values"))

    return generate


def test_runs_take_up_only_what_is_missing(spark, tmp_path):
    ids, path, asked = spark.range(5).withColumnRenamed("id", "design_id"), f"file://{tmp_path}/r", []
    first = runs.execute(ids, maker(spark, lost=[1], spoilt=[2, 3], asked=asked), path, 2, FIELDS)
    assert first == {"ok": 2, "pending": 3, "failed": 0, "grids": 18, "bad_grids": 8}
    second = runs.execute(ids, maker(spark, spoilt=[3], asked=asked), path, 2, FIELDS)
    assert second == {"ok": 2, "pending": 0, "failed": 1, "grids": 12, "bad_grids": 4}
    third = runs.execute(ids, maker(spark, asked=asked), path, 2, FIELDS)  # nothing is left: what failed twice is given up
    assert third["grids"] == 0 and asked == [[0, 1, 2, 3, 4], [1, 2, 3], []]
    state = {r.design_id: (r.state, r.run, r.attempts, r.n_present, r.n_bad) for r in runs.latest(spark, path).collect()}
    assert state == {0: ("ok", 1, 1, 4, 0), 1: ("ok", 2, 2, 4, 0), 2: ("ok", 2, 2, 4, 0), 3: ("failed", 2, 2, 0, 4), 4: ("ok", 1, 1, 4, 0)}
    whole = runs.whole_fields(spark, path)
    assert whole.count() == 16 and {r.design_id for r in whole.collect()} == {0, 1, 2, 4}


def test_a_run_that_broke_off_is_repeated_under_its_number(spark, tmp_path):
    ids, path = spark.range(3).withColumnRenamed("id", "design_id"), f"file://{tmp_path}/b"

    def broken(designs):
        raise RuntimeError("no more")

    try:
        runs.execute(ids, broken, path, 2, FIELDS)
    except RuntimeError:
        pass
    # one that wrote its fields, but not its entries
    maker(spark)(ids.where("design_id = 0")).withColumn("bad", F.lit(False)).write.parquet(f"{path}/fields/run=1")
    assert runs.execute(ids, maker(spark), path, 2, FIELDS)["ok"] == 3
    assert {r.run for r in runs.latest(spark, path).collect()} == {1} and runs.whole_fields(spark, path).count() == 12
    twice = maker(spark)(ids).unionByName(maker(spark)(ids))
    assert runs.execute(ids, lambda d: twice, f"{path}2", 2, FIELDS)["ok"] == 3  # repeated keys count once
    assert runs.whole_fields(spark, f"{path}2").count() == 12


def test_assembly_wants_one_whole_grid_a_channel(spark):
    names = ("Mu_avg", "Magnetization", "Mag_Bx", "Mag_By")
    kind = "design_id long, phase_idx int, field string, n_r int, n_a int, values array<double>"
    whole = [(0, 0, f, 1, 2, [1.0, 2.0]) for f in names]
    twice = [(0, 1, f, 1, 2, [1.0, 2.0]) for f in names] + [(0, 1, "Mu_avg", 1, 2, [5.0, 6.0])]
    holes = [(0, 2, f, 1, 2, [1.0, None if f == "Mag_By" else 2.0]) for f in names]
    got = assemble.assemble(spark.createDataFrame(whole + twice + holes, kind), 3, strict=False).collect()
    assert [r.sample_ix for r in got] == [0]
    for bad in (twice, holes):
        try:
            assemble.assemble(spark.createDataFrame(whole + bad, kind), 3).collect()
        except Exception as e:
            assert "incomplete sample of design 0" in str(e)
        else:
            raise AssertionError
