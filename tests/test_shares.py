"""Shares of disks that are made in a phase's row, against points as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrid.functions import regions, shares
from fieldgrid.operators import raster
from fieldgrid.operators.grid import Grid
from fieldgrid.plans import queries as q


@pytest.mark.parametrize("name", ["mu_avg_grid", "magnetization_grid", "sample_arrays", "area_fractions", "refined_averages"])
def test_points_and_parts_are_no_rows(spark, small, name):
    plan = q.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan.replace("aggregate(", "")
    assert plan.count("Generate") == 1  # of phases


@pytest.mark.parametrize(("g", "k"), [(Grid(n_r=4, n_a=12), 64), (Grid(n_r=7, n_a=31, ang_1=-10.0, ang_2=75.0), 33)])
def test_shares_equal_points_as_rows(spark, small, g, k):
    """Designs of two slot pitches, dealt anyhow; blocks smaller than a ring."""
    p = q.phases(spark, small).where("design_id < 12").withColumn("number_stator_slots", F.when(F.col("design_id") % 3 == 0, 24).otherwise(F.col("number_stator_slots"))).orderBy("phase_deg")
    keys = ["design_id", "phase_idx", "ir", "ia"]
    want, got = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (raster.point_fractions(p, g, k), raster.area_fractions(p, g, k)))
    assert len(got) == 36 * g.n_r * g.n_a and (got[want.columns] == want).all().all()
    rows = raster.averages(raster.area_fractions(p, g, k, arrays=True)).toPandas().sort_values(keys[:2])
    cells = raster.averages(raster.area_fractions(p, g, k)).toPandas().sort_values(keys)
    for c in ("code", "mu_avg", "magnetization"):
        assert (np.concatenate(rows[c].to_list()) == cells[c].to_numpy()).all()


def test_cells_away_from_edges_hold_their_centres_flags(spark, small, monkeypatch):
    p, g = q.phases(spark, small).where("design_id < 20"), Grid(n_r=20, n_a=60)
    quick = {tuple(r)[:4]: tuple(r)[4:] for r in raster.point_fractions(p, g, 32).collect()}
    monkeypatch.setattr(raster, "_inside", lambda g: F.lit(False))
    assert quick == {tuple(r)[:4]: tuple(r)[4:] for r in raster.point_fractions(p, g, 32).collect()}


def test_a_level_of_parts_at_least(spark, small):
    p = q.phases(spark, small).where("design_id < 2")
    assert raster.refined_fractions(p, Grid(n_r=4, n_a=12), 1.0).agg(F.max("n_parts")).collect()[0][0] == 4


@pytest.mark.parametrize(("g", "k"), [(Grid(n_r=4, n_a=12), 64), (Grid(n_r=7, n_a=31, ang_1=-10.0, ang_2=75.0), 32), (Grid(n_r=3, n_a=40), 1024)])
def test_totals_equal_points_as_rows(spark, small, g, k):
    """The grid's sums of shares, for designs of two slot pitches; angles that come again with the slots, and others."""
    p = q.phases(spark, small).where("design_id < 12").withColumn("number_stator_slots", F.when(F.col("design_id") % 3 == 0, 24).otherwise(F.col("number_stator_slots"))).orderBy("phase_deg")
    want = raster.point_fractions(p, g, k).groupBy("design_id", "phase_idx").agg(*[F.sum(f).alias(f) for f in raster.FLAGS])
    got = raster.area_totals(p, g, k)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_area_fractions_are_of_the_whole_grid(spark, small):
    """The query's shares against the cells of the reference's 80 x 240 grid, made one by one."""
    got = {r[:2]: r[2:] for r in q.queries()["area_fractions"](spark, small).where("design_id < 2").select("design_id", "phase_idx", *raster.FLAGS).collect()}
    cells = raster.area_fractions(q.phases(spark, small).where("design_id < 2"), Grid(), 64)
    sums = cells.groupBy("design_id", "phase_idx").agg(F.count("*").alias("n"), *[F.sum(f) for f in raster.FLAGS]).collect()
    assert len(got) == 6 and {r.n for r in sums} == {80 * 240} and {r[:2]: r[3:] for r in sums} == got


@pytest.mark.parametrize(("g", "tolerance"), [(Grid(n_r=4, n_a=12), 1 / 64), (Grid(n_r=7, n_a=31, ang_1=-10.0, ang_2=75.0), 1 / 16), (Grid(n_r=3, n_a=16), 1.0)])
def test_few_parts_are_computed_whole(spark, small, monkeypatch, g, tolerance):
    """As if they were split and picked, with what doesn't turn once a design and slot pitch."""
    p = regions.with_radii(q.phases(spark, small).where("design_id < 12")).orderBy("design_id", "phase_idx").toPandas()
    c = {x: p[x].to_numpy(float) for x in shares.COLUMNS}
    rings, angles = (np.arange(g.n_r) + 0.5) * g.dr + g.r_in, (np.arange(g.n_a) + 0.5) * g.da + g.ang_1
    points, still = [], shares._Points.still
    monkeypatch.setattr(shares._Points, "still", lambda self, rho: points.append(len(self.r)) or still(self, rho))
    got = shares.refined(c, rings, angles, g.disk, tolerance)
    last = shares._last_level(tolerance)
    assert sum(points) == 12 * g.n_r * shares._period(angles, 10.0) * sum(4**k for k in range(last + 1))
    monkeypatch.setattr(shares, "WHOLE", 0)
    want = shares.refined(c, rings, angles, g.disk, tolerance)
    for name in ("code", "n_parts", "f_open"):
        assert (got[name] == want[name]).all()
    for name in raster.FLAGS:
        assert np.abs(got[name] - want[name]).max() < 1e-14
    if tolerance == 1 / 64:
        assert 10 * sum(points[: last + 1]) < want["n_parts"].sum()
