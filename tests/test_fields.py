"""Hand-computed cases and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrid.functions import draws, regions
from fieldgrid.operators import assemble, dataset, design, grid, raster, spectral
from fieldgrid.operators.grid import Grid
from fieldgrid.plans import queries as q
from fieldgrid.sources import files


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(("u", "want"), [(0.5, 10 - math.sqrt(7.1875)), (0.1, 5 + math.sqrt(1.0625))])
def test_triangular(spark, u, want):
    got = one(spark.range(1).select(draws.triangular(F.lit(u), F.lit(5.0), F.lit(10.0), F.lit(7.125)).alias("v"))).v
    assert got == pytest.approx(want, abs=1e-12)


def test_designs_keep_bounds_and_units(spark):
    d = design.sample_designs(spark.range(500).withColumnRenamed("id", "design_id"))
    assert d.schema["slot_Hs0"].metadata == {"unit": "mm"}
    bad = d.where("stator_outer_diameter < 68 OR stator_outer_diameter > 81 OR pole_thickness < 1.5 OR rotor_inner_diameter / 2 + pole_thickness > 44 OR pole_embrance NOT BETWEEN 0.6 AND 0.95 OR slot_Hs2 <= 0 OR slot_Bs0 < 1")
    assert bad.count() == 0


def test_draws_do_not_depend_on_partitions(spark):
    ids = spark.range(300).withColumnRenamed("id", "design_id")
    a = design.sample_phases(design.sample_designs(ids.repartition(1))).collect()
    b = design.sample_phases(design.sample_designs(ids.repartition(8))).collect()
    assert sorted(a) == sorted(b)


def test_polar_grid(spark):
    g = Grid()
    r = grid.with_cells(spark.range(1), g).agg(F.min("r"), F.max("r"), F.min("th"), F.max("th"), F.count("*")).first()
    assert tuple(r) == (27.609375, 44.890625, 0.25, 119.75, 19200)
    assert g.disk * 27.609375 == pytest.approx(0.0799792, abs=1e-6)
    c = grid.corners(spark.range(1), Grid(n_r=2, n_a=3, r_in=1.0, r_ext=3.0, ang_2=90.0)).collect()
    assert len(c) == 12 and {(round(r.x, 9), round(r.y, 9)) for r in c if r.ia == 3} == {(0, 1), (0, 2), (0, 3)} and {(r.x, r.y) for r in c if r.ia == 0} == {(1, 0), (2, 0), (3, 0)}


def test_slot_opening(spark):
    r = one(spark.range(1).select(F.degrees(regions.slot_opening_angle(F.lit(36.74), F.lit(1.1))).alias("a")))
    assert r.a == pytest.approx(1.715507, abs=1e-6)


def test_codes_cover_every_cell_and_poles_follow_embrace(spark, small):
    g = Grid(n_r=40, n_a=120)
    p = q.phases(spark, small).where("design_id < 8")
    codes = raster.material_codes(p, g)
    assert {r["count"] for r in codes.groupBy("design_id", "phase_idx").count().collect()} == {4800}
    ring = raster.cells_of(p, Grid(n_r=60, n_a=840)).where("r > r_ri AND r < r_pole")
    for r in ring.groupBy("design_id", "phase_idx").agg(F.avg((F.col("pole_p") | F.col("pole_n")).cast("double")).alias("f"), F.first("pole_embrance").alias("e")).collect():
        assert r.f == pytest.approx(r.e, abs=0.03)


def test_no_region_overlaps_another(spark, small):
    c = raster.cells_of(q.phases(spark, small), Grid(n_r=30, n_a=90))
    n = F.col("iron").cast("int") + F.col("pole_p").cast("int") + F.col("pole_n").cast("int") + F.col("copper").cast("int")
    # only edges that two regions share
    assert c.where((n > 1) & (F.abs(F.col("r") - F.col("r_pole")) > 1e-9)).count() == 0


def test_cells_away_from_edges_need_no_points(spark, small, monkeypatch):
    p, g = q.phases(spark, small).where("design_id < 20"), Grid(n_r=20, n_a=60)
    quick = {tuple(r)[:4]: tuple(r)[4:] for r in raster.area_fractions(p, g, 32).collect()}
    codes = {tuple(r)[:4]: r.code for r in raster.material_codes(p, g).collect()}
    assert {k: v[0] for k, v in quick.items()} == codes
    assert 0 < raster.cells_of(p, g).where(raster._inside(g)).count() < len(quick)
    monkeypatch.setattr(raster, "_inside", lambda g: F.lit(False))
    full = {tuple(r)[:4]: tuple(r)[4:] for r in raster.area_fractions(p, g, 32).collect()}
    assert quick == full


@pytest.mark.parametrize(("f", "mu", "m"), [((0.5, 0.25, 0.0, 0.0), 2500.5125, 0.25), ((0.8, 0.0, 0.0, 0.4), 4000.3996, 0.0)])
def test_averages(spark, f, mu, m):
    d = spark.createDataFrame([(0, 0, 0, 0, *f)], "design_id long, phase_idx int, ir int, ia int, f_iron double, f_p double, f_n double, f_copper double")
    r = one(raster.averages(d))
    assert (r.mu_avg, r.magnetization) == (pytest.approx(mu), pytest.approx(m))


def fields(spark, rows):
    return spark.createDataFrame(rows, "design_id long, phase_idx int, field string, n_r int, n_a int, values array<double>")


def test_mirror(spark):
    f = fields(spark, [(0, 0, "Mu_avg", 2, 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])])
    image = assemble.mirror(f, 3).where("phase_idx = 3")
    assert one(image)["values"] == [3, 2, 1, 6, 5, 4]
    back = image.withColumn("values", grid.mirrored(F.col("values"), F.col("n_r"), F.col("n_a")))
    assert one(back)["values"] == [1, 2, 3, 4, 5, 6]


def test_completeness(spark):
    ids = spark.range(3).withColumnRenamed("id", "design_id")
    want = assemble.expected_keys(ids, 3)
    have = want.where("NOT (field = 'Mu_avg' AND design_id = 1 AND phase_idx = 2)")
    assert [r.design_id for r in assemble.missing_designs(want, have).collect()] == [1]


def test_assembly_is_all_or_nothing(spark):
    whole = [(0, 0, f, 1, 2, [1.0, 2.0]) for f in ("Mu_avg", "Magnetization", "Mag_Bx", "Mag_By")]
    short = [(0, 1, f, 1, 2, [1.0, 2.0]) for f in ("Mu_avg", "Magnetization", "Mag_Bx")]
    r = one(assemble.assemble(fields(spark, whole), 3))
    assert (r.sample_ix, r.x, r.y) == (0, [[1, 2], [1, 2]], [[1, 2], [1, 2]])
    assert assemble.assemble(fields(spark, whole + short), 3, strict=False).count() == 1
    with pytest.raises(Exception, match="incomplete sample"):
        assemble.assemble(fields(spark, whole + short), 3).collect()


def test_split_batches_and_losses(spark):
    s = assemble.dense_ordinal(spark.createDataFrame([(x,) for x in (50, 10, 40, 20, 70, 60, 30)], "k long"), ["k"])
    assert [r.sample_ix for r in s.orderBy("k").collect()] == list(range(7))
    assert dataset.split(s).where("part = 'train'").count() == 5
    sizes = sorted(r["count"] for r in dataset.minibatches(s.where("sample_ix < 5"), 1, 0, 2).groupBy("batch_id").count().collect())
    assert sizes == [1, 2, 2]
    rows = spark.createDataFrame([(0, 1.0, 0.0), (0, 1.0, 0.0), (1, 1.0, 0.0), (1, 1.0, 0.0), (2, 2.0, 0.0)], "batch_id long, out double, y double")
    assert (one(dataset.epoch_loss(rows)).epoch_loss, one(dataset.mse(rows)).mse) == (2.0, 1.6)


def test_parameter_count(spark):
    shapes = spark.createDataFrame([(n, s) for n, s in dataset.operator_shapes(2, 2, 80, 240)], "name string, shape array<int>")
    assert one(dataset.parameter_count(shapes)).n_params == 706_101


def cells_of(spark, x):
    return spark.createDataFrame([(0, c, i, j, float(v)) for (c, i, j), v in np.ndenumerate(x)], "sample_ix long, ch int, ir int, ia int, v double")


@pytest.mark.parametrize("n_a", [6, 7])
def test_spectra(spark, n_a):
    x = np.random.default_rng(1).normal(size=(2, 5, n_a))
    cells, f = cells_of(spark, x), np.fft.rfft2(x)
    s = spectral.forward(cells, 5, n_a)
    for r in s.collect():
        assert complex(r.re, r.im) == pytest.approx(f[r.ch, r.kx, r.ky], abs=1e-9)
    for r in spectral.inverse(s, 5, n_a).collect():
        assert r.v == pytest.approx(x[r.ch, r.ir, r.ia], abs=1e-9)
    w = F.when((F.col("ky") == 0) | (F.col("ky") * 2 == n_a), 1).otherwise(2)
    energy = one(s.agg(F.sum(w * (F.col("re") ** 2 + F.col("im") ** 2)).alias("e"))).e
    assert energy / (5 * n_a) == pytest.approx((x**2).sum())


def test_blocks_of_modes_overlap_to_the_second(spark):
    x = np.ones((1, 8, 8))
    low = spectral.truncate(spectral.forward(cells_of(spark, x), 8, 8), 8, 8, 5, 240)
    assert {(r.kx, r.block) for r in low.collect()} == {(k, 1 if k < 3 else 2) for k in range(8)}


def test_convolution_equals_numpy(spark):
    x = np.random.default_rng(2).normal(size=(2, 8, 8))
    w = spectral.seeded_weights(spark, 2, 3, 3, 4, 5)
    w1, w2 = (np.zeros((2, 3, 3, 4), complex) for _ in range(2))
    for r in w.collect():
        (w1 if r.block == 1 else w2)[r.ch_in, r.ch_out, r.wx, r.ky] = complex(r.wr, r.wi)
    f, g = np.fft.rfft2(x), np.zeros((3, 8, 5), complex)
    g[:, :3, :4] = np.einsum("ixy,ioxy->oxy", f[:, :3, :4], w1)
    g[:, -3:, :4] = np.einsum("ixy,ioxy->oxy", f[:, -3:, :4], w2)
    want = np.fft.irfft2(g, s=(8, 8))
    for r in spectral.convolve(cells_of(spark, x), w, 8, 8, 3, 4).collect():
        assert r.v == pytest.approx(want[r.ch, r.ir, r.ia], abs=1e-9)


def test_erf():
    x = np.linspace(-6, 6, 241)
    assert np.abs(spectral.erf(x) - [math.erf(v) for v in x]).max() < 1e-12


def test_fit_finds_a_linear_map(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 4, 4))
    w = rng.normal(size=(4, 3)) + 1j * rng.normal(size=(4, 3))
    f = np.fft.rfft2(x)
    rows = lambda a: spark.createDataFrame([(int(i), 0, int(k), int(m), float(v.real), float(v.imag)) for (i, k, m), v in np.ndenumerate(a)], spectral.SPECTRUM)
    for r in spectral.fit(rows(f), rows(f * w)).collect():
        assert complex(r.wr, r.wi) == pytest.approx(w[r.kx, r.ky], abs=1e-4)


def test_scores_equal_numpy_in_any_batching(spark, small):
    s = q.samples(spark, small)
    w = spectral.operator_weights(2, 2, 8, 8, 1)
    got = {r.sample_ix: np.array(r.out) for r in spectral.score(s.repartition(3), w).collect()}
    for r in s.limit(5).collect():
        want = spectral.apply_operator(np.array(r.x, float).reshape(1, 2, 8, 8), w)[0].reshape(2, 64)
        assert np.abs(got[r.sample_ix] - want).max() < 1e-4


def test_matrix_text_and_names(spark):
    rows = [("1,2\n3,4\n",), ("1,2\r\n3,4",), ("1,2\n3",), ("1,x",), ("",), (None,), ("{\"k\": 69}",)]
    got = [r.reason for r in files.parsed(spark.createDataFrame(rows, "value string")).collect()]
    assert got == [None, None, "ragged", "not a number", "empty", "empty", "not a number"]
    n = spark.createDataFrame([("/a/Mag_Bx_12_p3.csv",), ("nothing",)], "p string").select(*[c.alias(k) for k, c in files.parse_name(F.col("p")).items()])
    assert [tuple(r) for r in n.collect()] == [("Mag_Bx", 12, 3), ("", None, None)]


def test_resampling_drops_points_outside(spark):
    p = spark.createDataFrame([(27.5, 0.0, 1.0), (27.6, 0.1, 3.0), (45.0, 1.0, 9.0), (30.0, 120.0, 9.0)], "r double, th double, b double")
    assert [tuple(r) for r in raster.resample(p, Grid(), ["b"]).collect()] == [(0, 0, 2, 2.0)]


def test_averages_need_no_shuffle_of_points(spark, small):
    p = q.phases(spark, small)
    for df in (raster.area_fractions(p, Grid(n_r=4, n_a=12), 16), raster.material_codes(p, Grid(n_r=4, n_a=12)).groupBy("design_id", "phase_idx", "code").count()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # designs are dealt by id, and that is all
        assert plan.count("Exchange ") == plan.count("Exchange hashpartitioning(design_id") == 1
        assert plan.count("FileScan") == 1


def test_shares_of_many_points_are_near_exact_areas(spark, small):
    """Points in a disk against a fine lattice of the same disk, on the whole grid of 80 x 240 cells of two designs."""
    p, g = q.phases(spark, small).where("design_id < 2 AND phase_idx = 0"), Grid()
    got = {(r.design_id, r.ir, r.ia): r for r in raster.area_fractions(p, g, 1024).collect()}
    assert len(got) == 2 * g.n_r * g.n_a
    params = {r.design_id: r.asDict() for r in regions.with_radii(p).collect()}
    rng, near = np.random.default_rng(1), [k for k, r in got.items() if 0 < r.f_iron < 1]
    for k in [near[i] for i in rng.choice(len(near), 60, replace=False)]:
        d, r, th = params[k[0]], g.r_in + (k[1] + 0.5) * g.dr, (k[2] + 0.5) * g.da
        u = (np.arange(160) + 0.5) / 80 - 1
        x, y = np.meshgrid(u, u)
        inside = x**2 + y**2 <= 1
        px, py = r * (1 + g.disk * x[inside]), r * g.disk * y[inside]
        rr, tt = np.hypot(px, py), th + np.degrees(np.arctan2(py, px))
        phi = np.radians(tt - np.floor(tt / d["slot_pitch"] + 0.5) * d["slot_pitch"])
        sx, sy, deep = rr * np.cos(phi), np.abs(rr * np.sin(phi)), d["chord"] - rr * np.cos(phi)
        half = np.where(deep <= d["slot_Hs1"], d["slot_Bs0"] / 2 + (d["slot_Bs1"] - d["slot_Bs0"]) / 2 * deep / d["slot_Hs1"], d["slot_Bs1"] / 2 + (d["slot_Bs2"] - d["slot_Bs1"]) / 2 * (deep - d["slot_Hs1"]) / d["slot_Hs2"])
        copper = (deep >= 0) & (deep <= d["slot_Hs1"] + d["slot_Hs2"]) & (sy <= half)
        iron = (rr >= d["r_pole"]) & (rr <= d["r_ro"]) | (rr >= d["r_si"]) & (rr <= d["r_so"]) & ~copper & ((np.abs(phi) > d["opening_rad"] / 2) | (sx <= d["chord"]))
        assert got[k].f_iron == pytest.approx(iron.mean(), abs=0.012)
        assert got[k].f_copper == pytest.approx(copper.mean(), abs=0.012)


def test_matrix_files_with_keys_in_their_names(spark, tmp_path):
    (tmp_path / "Mu_avg_3_p1.csv").write_text("1.0,2.0\n3.0,4.5\n")
    (tmp_path / "Mag_Bx_12_p0.csv").write_text("0.5,-1e3")
    (tmp_path / "Mag_By_12_p0.csv").write_text("broken,1")
    got = {(r.field, r.design_id, r.phase_idx, r.n_r, r.n_a, tuple(r["values"])) for r in files.read_matrices(spark, f"file://{tmp_path}").collect()}
    assert got == {("Mu_avg", 3, 1, 2, 2, (1.0, 2.0, 3.0, 4.5)), ("Mag_Bx", 12, 0, 1, 2, (0.5, -1000.0))}


def test_fit_of_two_channels(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 2, 4, 6))
    f = np.fft.rfft2(x)
    w = rng.normal(size=(2, 4, 4)) + 1j * rng.normal(size=(2, 4, 4))
    y = (f * w).sum(axis=1)
    rows = [(s, c, i, j, float(v.real), float(v.imag)) for (s, c, i, j), v in np.ndenumerate(np.concatenate([f, y[:, None]], axis=1))]
    d = spark.createDataFrame(rows, spectral.SPECTRUM)
    got = spectral.fit_two(*(d.where(f"ch = {c}") for c in (0, 1, 2))).collect()
    a, b = f[:, 0], f[:, 1]
    for r in got:
        m = np.stack([a[:, r.kx, r.ky], b[:, r.kx, r.ky]], axis=1)
        best = np.linalg.solve(m.conj().T @ m + 1e-6 * np.eye(2), m.conj().T @ y[:, r.kx, r.ky])
        assert (complex(r.w1r, r.w1i), complex(r.w2r, r.w2i)) == (pytest.approx(best[0], abs=1e-6), pytest.approx(best[1], abs=1e-6))
    assert len(got) == 16


def plain_gelu(v):
    return 0.5 * v * (1 + math.erf(v / math.sqrt(2)))


def plain_operator(x, weights, layers):
    """The operator by loops and sums over all modes, without numpy's FFT; x: channels x n_r x n_a."""
    n_r, n_a = x.shape[1:]

    def layer(v, name, i, act):
        w, b = weights[f"{name}.{i}.weight"], weights[f"{name}.{i}.bias"]
        out = np.empty((len(w), n_r, n_a))
        for o, r, a in np.ndindex(*out.shape):
            s = sum(w[o][c] * v[c, r, a] for c in range(len(v))) + b[o]
            out[o, r, a] = plain_gelu(s) if act else s
        return out

    for i in range(3):
        x = layer(x, "lift", i, i < 2)
    for k in range(layers):
        w1, w2 = weights[f"spectral.{k}.w1"], weights[f"spectral.{k}.w2"]
        m1, m2 = w1.shape[2:]
        turn = lambda kx, ky, r, a: 2j * np.pi * (kx * r / n_r + ky * a / n_a)
        r, a = np.meshgrid(np.arange(n_r), np.arange(n_a), indexing="ij")
        out = np.zeros((w1.shape[1], n_r, n_a))
        for kx in range(n_r):
            for ky in range(m2):
                if n_r - m1 <= kx or kx < m1:
                    w = w2[:, :, kx - (n_r - m1), ky] if kx >= n_r - m1 else w1[:, :, kx, ky]
                    f = [(x[c] * np.exp(-turn(kx, ky, r, a))).sum() for c in range(len(x))]
                    for o in range(w.shape[1]):
                        g = sum(f[c] * w[c, o] for c in range(len(x)))
                        times = 1 if ky == 0 or 2 * ky == n_a else 2
                        out[o] += times * (g * np.exp(turn(kx, ky, r, a))).real / (n_r * n_a)
        beside = layer(x, f"bypass.{k}", 0, False)
        x = np.vectorize(plain_gelu)(out + beside)
    for i in range(3):
        x = layer(x, "project", i, i < 2)
    return x


def test_operator_equals_a_plain_one(spark):
    x = np.random.default_rng(9).normal(size=(2, 2, 6, 8))
    w = spectral.operator_weights(2, 2, 6, 8, seed=5, mlp_width=5, layers=2, modes=(3, 4))
    s = spark.createDataFrame([(i, 6, 8, v.reshape(2, -1).tolist()) for i, v in enumerate(x)], "sample_ix long, n_r int, n_a int, x array<array<double>>")
    for r in spectral.score(s, w).collect():
        assert np.array(r.out).reshape(2, 6, 8) == pytest.approx(plain_operator(x[r.sample_ix], w, 2), abs=1e-5)


def test_convolution_and_inverse_of_whole_grids(spark):
    x = np.random.default_rng(10).normal(size=(2, 80, 240))
    s = spark.createDataFrame([(0, 80, 240, x.reshape(2, -1).tolist())], "sample_ix long, n_r int, n_a int, x array<array<double>>")
    back = one(spectral.irfft2(spectral.spectra_arrays(s)))
    assert np.array(back.x).reshape(2, 80, 240) == pytest.approx(x, abs=1e-9)
    w = np.ones((2, 1, 80, 121)) + 0j  # all modes of both channels: their sum
    out = one(spectral.convolve_batches(s, w, w)).out
    assert np.array(out).reshape(80, 240) == pytest.approx(x.sum(axis=0), abs=1e-9)


def test_a_single_layer_is_activated():
    x = np.random.default_rng(1).normal(size=(1, 2, 1, 3))
    w, b = [[1.0, 2.0]], [0.5]
    plain = x[:, :1] + 2 * x[:, 1:] + 0.5
    assert spectral.dense(x, [(w, b)]) == pytest.approx(np.vectorize(plain_gelu)(plain), abs=1e-12)
    assert spectral.dense(x, [(w, b)], None) == pytest.approx(plain)


def test_refined_shares_are_near_a_fine_lattice(spark, small):
    """The whole grid of a design: every share within 0.001 of 8,192 points' with fewer than 1,024 parts a disk."""
    p = q.phases(spark, small).where("design_id = 1 AND phase_idx = 0")
    keys, shares = ["ir", "ia"], ["f_iron", "f_p", "f_n", "f_copper"]
    fine = raster.area_fractions(p, Grid(), 8192).toPandas().sort_values(keys)
    got = raster.refined_fractions(p, Grid()).toPandas().sort_values(keys)
    assert len(got) == 19200 and (got.code.to_numpy() == fine.code.to_numpy()).all()
    assert np.abs(got[shares].to_numpy() - fine[shares].to_numpy()).max() < 0.001
    assert got.n_parts.max() < 1024 and got.n_parts[got.n_parts > 1].mean() < 400


def test_refinement_has_no_shuffle_of_parts_and_keeps_its_bound(spark, small):
    p, g = q.phases(spark, small).where("design_id < 4"), Grid(n_r=10, n_a=30)
    rough = raster.refined_fractions(p, g, 1 / 4)
    assert rough._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of designs
    keys = ["design_id", "phase_idx", "ir", "ia"]
    a, b = (d.toPandas().sort_values(keys) for d in (rough, raster.refined_fractions(p, g, 1 / 4096)))
    for f in ("f_iron", "f_p", "f_n", "f_copper"):
        assert (np.abs(a[f].to_numpy() - b[f].to_numpy()) <= a.f_open.to_numpy() + 1e-12).all()
    assert (a.n_parts <= b.n_parts.to_numpy()).all() and (b.f_open <= a.f_open.to_numpy()).all()


def test_filled_cells_have_the_nearest_point(spark):
    """Against all points of a key: clusters, wide gaps, equal distances, repeated points, null keys and values, points outside."""
    rng, g = np.random.default_rng(4), Grid(n_r=12, n_a=40)
    rows = [(k, 27.5 + 17.5 * float(rng.random()) ** 3, 120.0 * float(rng.random()) ** 2) for k in (0, 1, None) for _ in range(25)]
    rows += [(2, 30.0, 60.0), (3, 44.99, 119.99), (3, 27.5, 0.0), (4, 36.25, 30.0), (4, 36.25, 90.0), (4, 36.25, 90.0), (5, 50.0, 10.0), (0, None, 3.0)]
    rows = [(i, *r, None if i % 11 == 0 else float(i)) for i, r in enumerate(rows)]
    points = spark.createDataFrame(rows, "id long, key int, r double, th double, v double")
    df = raster.filled(points, g, ["v"], "id", ("key",))
    got = {(r.key, r.ir, r.ia): (r.n, r.from_id, r.v) for r in df.collect()}
    want = {}
    for key in {r[1] for r in rows}:
        own = [(i, r, th, v) for i, k, r, th, v in rows if k == key and r is not None and 27.5 <= r < 45]
        for c in range(12 * 40 if own else 0):
            ir, ia = divmod(c, 40)
            inside = [x for x in own if int((x[1] - 27.5) / g.dr) == ir and int(x[2] / g.da) == ia]
            cr, ct = 27.5 + (ir + 0.5) * g.dr, (ia + 0.5) * g.da
            if inside:
                held = [x[3] for x in inside if x[3] is not None]
                want[key, ir, ia] = (len(inside), None, pytest.approx(sum(held) / len(held)) if held else None)
            else:
                x = min(own, key=lambda x: (round(x[1] ** 2 + cr**2 - 2 * x[1] * cr * math.cos(math.radians(x[2] - ct)), 9), x[0]))
                want[key, ir, ia] = (0, x[0], x[3])
    assert {k[0] for k in got} == {0, 1, 2, 3, 4, None} and got == want
    assert raster.filled(points.limit(0), g, ["v"], "id", ("key",)).count() == 0
    with pytest.raises(ValueError):
        raster.filled(points, Grid(ang_2=270.0), ["v"], "id")


@pytest.mark.parametrize(("n_r", "n_a"), [(80, 240), (7, 9), (6, 5), (3, 1), (1, 4)])
def test_spectra_in_rows(spark, n_r, n_a):
    """Against numpy, there and back, without a shuffle or Python; null channels stay null."""
    x = np.random.default_rng(2).normal(size=(2, n_r, n_a))
    df = spark.createDataFrame([(0, [c.ravel().tolist() for c in x] + [None])], "sample_ix long, x array<array<double>>")
    s = spectral.rows_spectra(df, n_r, n_a).withColumn("back", F.transform("spectra", lambda z: spectral.row_values(z, n_r, n_a)))
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    r = one(s)
    assert r.spectra[2] is None and r.back[2] is None
    for c in range(2):
        np.testing.assert_allclose([[complex(*z) for z in row] for row in r.spectra[c]], np.fft.rfft2(x[c]), atol=1e-9)
        np.testing.assert_allclose(np.reshape(r.back[c], (n_r, n_a)), x[c], atol=1e-12)


def test_dense_spectra_fill_missing_modes_with_zeros(spark):
    s = spark.createDataFrame([(0, 0, 1, 2, 3.0, -1.0), (0, 1, 0, 0, 4.0, 5.0)], "sample_ix long, ch int, kx int, ky int, re double, im double")
    d = spectral.dense_spectra(s, 3, 4).withColumn("v", spectral.row_values(F.col("spectrum"), 3, 4))
    for r in d.collect():
        f = np.zeros((3, 3), complex)
        f[(1, 2) if r.ch == 0 else (0, 0)] = 3 - 1j if r.ch == 0 else 4 + 5j
        np.testing.assert_allclose(np.reshape(r.v, (3, 4)), np.fft.irfft2(f, s=(3, 4)), atol=1e-12)


def test_fit_of_many_channels(spark):
    """Four channels against numpy's solution, two against fit_two; samples that lack a channel play no part."""
    rng = np.random.default_rng(6)
    z = rng.normal(size=(9, 5, 3, 2, 2))  # samples, channels with the target, kx, ky, parts
    rows = [(s, c, kx, ky, *map(float, z[s, c, kx, ky])) for s, c, kx, ky in np.ndindex(9, 5, 3, 2)]
    kind = "sample_ix long, ch int, kx int, ky int, re double, im double"
    x, y = spark.createDataFrame([*rows, (99, 0, 0, 0, 1.0, 1.0)], kind), spark.createDataFrame([r for r in rows if r[1] == 4], kind)
    got = {(r.kx, r.ky, r.ch): complex(r.wr, r.wi) for r in spectral.fit_many(x, y, [0, 1, 2, 3]).collect()}
    assert len(got) == 24
    c = z[..., 0] + 1j * z[..., 1]
    for kx, ky in np.ndindex(3, 2):
        a, b = c[:, :4, kx, ky], c[:, 4, kx, ky]
        want = np.linalg.solve(a.conj().T @ a + 1e-6 * np.eye(4), a.conj().T @ b)
        np.testing.assert_allclose([got[kx, ky, k] for k in range(4)], want, atol=1e-9)
    two = {(r.kx, r.ky): (r.w1r, r.w1i, r.w2r, r.w2i) for r in spectral.fit_two(x.where("ch = 0"), x.where("ch = 2"), y).collect()}
    many = {(r.kx, r.ky, r.ch): (r.wr, r.wi) for r in spectral.fit_many(x, y, [0, 2]).collect()}
    for k, w in two.items():
        np.testing.assert_allclose([*many[*k, 0], *many[*k, 2]], w, atol=1e-9)


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    s = spark.range(500).select(F.col("id").alias("sample_ix"), F.rand(1).alias("x"))
    tables = [files.write_bucketed(s.withColumnRenamed("x", c), f"file://{tmp_path}/{c}", f"pairs_{c}", 5) for c in "ab"]
    joined = tables[0].join(tables[1].hint("merge"), "sample_ix")
    assert joined.where("a = b").count() == 500
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    files.write_bucketed(s.limit(3).withColumnRenamed("x", "a"), f"file://{tmp_path}/a", "pairs_a", 5)  # replaced
    assert spark.table("pairs_a").count() == 3


@pytest.mark.parametrize("n", [1, 2, 7, 97, 1000, 4095, 4097])
def test_permutations_hit_each_place_once(spark, n):
    d = spark.range(n).select("id", *[dataset.permuted(F.col("id"), n, 3, e).alias(f"e{e}") for e in (0, 1)])
    assert "Exchange" not in d.coalesce(1)._jdf.queryExecution().executedPlan().toString()
    got = d.toPandas()
    for e in ("e0", "e1"):
        assert sorted(got[e]) == list(range(n))
    if n > 90:  # the order has nothing of the rows' own left, nor of another epoch's
        assert abs(np.corrcoef(got.id, got.e0)[0, 1]) < 0.3 and abs(np.corrcoef(got.e0, got.e1)[0, 1]) < 0.3
    b = dataset.permuted_batches(spark.range(n).withColumnRenamed("id", "sample_ix"), n, 3, 0, 32).groupBy("batch_id").count().toPandas()
    assert sorted(b["count"]) == sorted([32] * (n // 32) + [n % 32] * (n % 32 > 0))


def test_gelu_in_the_plan(spark):
    v = [0.0, -0.0, 1e-300, 0.5, -0.5, 2.999 * math.sqrt(2), 3 * math.sqrt(2), -3.5, 6.1, -8.4, 8.6, 40.0, -40.0, 1e300, *np.random.default_rng(0).normal(0, 3, 500).tolist()]
    d = spectral.with_gelu(spark.createDataFrame([(x,) for x in v] + [(None,), (float("nan"),)], "v double"), "v", "g")
    assert "Python" not in d._jdf.queryExecution().executedPlan().toString()
    for r in d.collect():
        if r.v is None or math.isnan(r.v):
            assert r.g is None if r.v is None else math.isnan(r.g)
        else:
            assert r.g == pytest.approx(0.5 * r.v * (1 + math.erf(r.v / math.sqrt(2))), abs=1e-12)
