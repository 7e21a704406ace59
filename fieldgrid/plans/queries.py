"""The operators over the driver's tables: part gives designs, embeddings 8 x 8 grids, lineitem and orders points and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws, regions
from ..operators import assemble, dataset, design, grid, raster, spectral
from ..operators.grid import Grid
from ..sources import files, quarantine, runs
from ..sources.files import table
from ..streaming import ingest, versions
from .sql import AVERAGES, BYPASS, CODES, LAYERS, N, POINTS, RANKS, SAMPLES, SEED, TOLERANCE, WHOLE

FIELDS = ("Mu_avg", "Magnetization", "Mag_Bx", "Mag_By")


def near(column: str, places: int = 9):
    """Rounded, and without a negative zero."""
    return (F.round(F.col(column), places) + 0.0).alias(column)


def design_ids(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("design_id"))


def designs(spark, d) -> DataFrame:
    return design.sample_designs(design_ids(spark, d), SEED)


def phases(spark, d) -> DataFrame:
    return design.sample_phases(design.dealt(designs(spark, d)), 3, SEED)


def rounded(df: DataFrame) -> DataFrame:
    return df.select("design_id", *[F.col(p) if p.startswith("number") else near(p) for p in design.UNITS])


def fields(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    v = F.col("vec_id")
    names = F.array(*[F.lit(f) for f in FIELDS])
    return e.select(
        F.floor(v / 12).alias("design_id"), (F.floor(v / 4) % 3).cast("int").alias("phase_idx"), F.element_at(names, (v % 4).cast("int") + 1).alias("field"),
        F.lit(N).alias("n_r"), F.lit(N).alias("n_a"), F.col("embedding").cast("array<double>").alias("values"), "label",
    )


def expected(spark, d) -> DataFrame:
    return assemble.expected_keys(fields(spark, d).select("design_id").distinct(), 3, FIELDS)


def present(spark, d) -> DataFrame:
    return fields(spark, d).where("label <> 9").drop("label")


def as_cells(df: DataFrame) -> DataFrame:
    return grid.to_cells(df).select("design_id", "phase_idx", "field", "ir", "ia", "v")


def samples(spark, d) -> DataFrame:
    """The last sample has as many channels as the table has rows for it: a channel without a row is null."""
    return assemble.assemble(fields(spark, d), 3, partial=True)


def tensor_cells(s: DataFrame) -> DataFrame:
    parts = F.explode(F.array(F.struct(F.lit("x").alias("tensor"), F.col("x").alias("t")), F.struct(F.lit("y").alias("tensor"), F.col("y").alias("t"))))
    s = s.select("sample_ix", "n_a", parts.alias("p")).select("sample_ix", "n_a", "p.tensor", F.posexplode("p.t").alias("ch", "values"))
    s = s.select("sample_ix", "tensor", "ch", "n_a", F.posexplode("values").alias("at", "v"))
    return s.select("sample_ix", "tensor", "ch", F.floor(F.col("at") / F.col("n_a")).cast("int").alias("ir"), (F.col("at") % F.col("n_a")).cast("int").alias("ia"), F.col("v").cast("double").alias("v"))


def channels(spark, d) -> DataFrame:
    """Cells with all four fields as channels."""
    number = F.array_position(F.array(*[F.lit(f) for f in FIELDS]), F.col("field")).cast("int") - 1
    return grid.to_cells(fields(spark, d)).select((F.col("design_id") * 3 + F.col("phase_idx")).alias("sample_ix"), number.alias("ch"), "ir", "ia", "v")


def spectra(spark, d) -> DataFrame:
    return spectral.forward(channels(spark, d), N, N)


def low(spark, d) -> DataFrame:
    return spectral.truncate(spectra(spark, d), N, N, RANKS["m1"], RANKS["m2"])


def weights(spark) -> DataFrame:
    return spectral.seeded_weights(spark, 2, 2, RANKS["m1"], RANKS["m2"], SEED)


def lines(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample_ix"), F.col("l_extendedprice").alias("y"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("out"))


def ordinals(spark, d) -> DataFrame:
    return assemble.dense_ordinal(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


def counted(flag) -> DataFrame:
    def run(spark, d):
        return raster.cells_of(phases(spark, d), CODES).groupBy("design_id", "phase_idx").agg(F.count_if(flag()).alias("n"))

    return run


def material_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cells of each material in each design and phase: the whole way from draws to codes in one plan."""
    return raster.material_codes(phases(spark, d), CODES).groupBy("design_id", "phase_idx", "code").agg(F.count("*").alias("n"))


def material_arrays(spark, d):
    a = grid.to_arrays(raster.material_codes(phases(spark, d), CODES), ["design_id", "phase_idx"], ["code"], CODES)
    return a.select("design_id", "phase_idx", F.array_join("code", ",").alias("codes"))


def grid_corners(spark, d):
    """Corners of a 2 x 4 grid over each design's stator."""
    c = grid.corners(designs(spark, d), Grid(n_r=2, n_a=4), F.col("stator_outer_diameter") / 2)
    return c.select("design_id", "ir", "ia", near("x", 6), near("y", 6))


def material_property_join(spark, d):
    p = raster.with_properties(raster.material_codes(phases(spark, d), CODES))
    return p.groupBy("material", "code").agg(F.count("*").alias("n"), (F.round(F.sum("mu"), 3) + 0.0).alias("mu"), (F.round(F.sum("m"), 3) + 0.0).alias("m"))


def shares(spark, d, arrays: bool = False):
    return raster.area_fractions(phases(spark, d), AVERAGES, POINTS, arrays)


def area_fractions(spark, d):
    """The regions' shares summed over the reference's whole grid."""
    return raster.area_totals(phases(spark, d), WHOLE, POINTS)


def refined_averages(spark, d):
    """Permeability and magnetisation by refined disks, the share that a boundary may cross, and the parts it took."""
    a = raster.averages(raster.refined_fractions(phases(spark, d), AVERAGES, TOLERANCE), ["f_open"])
    return a.select("design_id", "phase_idx", "ir", "ia", "code", "n_parts", "f_open", near("mu_avg", 6), near("magnetization", 6))


def sample_arrays(spark, d):
    """Codes, permeability and magnetisation of each design and phase as arrays, made in its row."""
    a = raster.averages(shares(spark, d, arrays=True))
    # values have nine places at most, so decimals sum exactly
    total = lambda c: F.aggregate(c, F.lit(0).cast("decimal(30,9)"), lambda x, y: (x + y.cast("decimal(20,9)")).cast("decimal(30,9)")).cast("double")
    return a.select("design_id", "phase_idx", F.array_join("code", ",").alias("codes"), F.size("mu_avg").alias("n"), total("mu_avg").alias("mu_avg"), (total("magnetization") + 0.0).alias("magnetization"))


def field_resample(spark, d):
    li = table(spark, d, "lineitem")
    p = li.select((27.5 + (F.col("l_partkey") % 1750) / 100.0).alias("r"), ((F.col("l_orderkey") % 12000) / 100.0).alias("th"), F.col("l_quantity").alias("bx"), F.col("l_discount").alias("b_y"))
    return raster.resample(p, SAMPLES, ["bx", "b_y"]).select("ir", "ia", "n", near("bx", 6), near("b_y", 6))


def field_filled(spark, d):
    """A value in every cell of each nation's grid, from its customers' few points."""
    c = table(spark, d, "customer")
    p = c.select("c_custkey", "c_nationkey", (27.5 + (F.col("c_custkey") * 37 % 1750) / 100.0).alias("r"), ((F.col("c_custkey") * 7919 % 12000) / 100.0).alias("th"), F.col("c_acctbal").cast("double").alias("v"))
    return raster.filled(p, SAMPLES, ["v"], "c_custkey", ("c_nationkey",)).select("c_nationkey", "ir", "ia", "n", "from_id", near("distance", 6), near("v", 6))


def design_csv_roundtrip(spark, d):
    path = files.scratch(spark, "designs")
    files.write_designs(designs(spark, d), path)
    return rounded(files.read_designs(spark, path))


def matrix_csv_roundtrip(spark, d):
    path = files.scratch(spark, "matrices")
    files.write_matrices(fields(spark, d), path)
    return as_cells(files.read_matrices(spark, path))


def field_parquet_roundtrip(spark, d):
    path = files.scratch(spark, "fields")
    files.write_fields(fields(spark, d), path)
    return as_cells(files.read_fields(spark, path))


def tensor_roundtrip(spark, d):
    path = files.scratch(spark, "samples")
    files.write_samples(samples(spark, d), path)
    return tensor_cells(spark.read.parquet(path))


def file_listing(spark, d):
    path = files.scratch(spark, "listing")
    files.write_matrices(fields(spark, d), path)
    p = files.listing(spark, path)
    pick = lambda k, t: F.regexp_extract("path", f"/{k}=([^/]+)/", 1).cast(t).alias(k)
    return p.select(pick("field", "string"), pick("design_id", "long"), pick("phase_idx", "int"))


def key_parse(spark, d):
    li = table(spark, d, "lineitem")
    field = F.element_at(F.array(*[F.lit(f) for f in assemble.FIELDS]), (F.col("l_linenumber") % 5) + 1)
    n = li.select(files.file_name(field, F.col("l_orderkey"), F.col("l_linenumber")).alias("name"))
    return n.withColumns(files.parse_name(F.col("name")))


def grid_quarantine(spark, d):
    """Matrix texts of all embeddings and the events' properties, which are none: the good and the rejected, by reason."""
    text = table(spark, d, "events").select(F.col("props").alias("value")).union(table(spark, d, "embeddings").select(F.array_join(F.col("embedding").cast("array<double>"), ",")))
    return files.parsed(text).groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))


def quarantine_tables(spark, d):
    """Every grid's text, some of them spoilt, and the events' properties, which are none: what becomes of each row."""
    e = table(spark, d, "embeddings")
    k, row = F.col("vec_id") % 20, lambda a: F.array_join(a.cast("array<double>"), ",")
    v = F.col("embedding")
    lines = lambda a: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: F.array_join(F.slice(a.cast("array<double>"), i * N + 1, N), ",")), "\n")
    text = (
        F.when(k == 1, F.concat(F.lit("NaN,"), row(F.slice(v, 2, 7)))).when(k == 2, F.concat(row(F.slice(v, 1, 7)), F.lit(",-Infinity"))).when(k == 3, row(F.slice(v, 1, 8)))
        .when(k == 4, F.concat(row(F.slice(v, 1, 8)), F.lit("\n"), row(F.slice(v, 9, 7)))).when(k == 5, F.lit(" \n")).when(k == 6, F.concat(row(v), F.lit(",x"))).otherwise(lines(v))
    )
    key = F.when(k == 9, F.col("vec_id") - 1).when(k != 10, F.col("vec_id"))
    grids = e.select(F.lit("grid").alias("field"), key.alias("design_id"), F.lit(0).alias("phase_idx"), text.alias("value"))
    events = table(spark, d, "events").select(F.lit("event").alias("field"), F.col("event_id").cast("long").alias("design_id"), F.lit(0).alias("phase_idx"), F.col("props").alias("value"))
    path = files.scratch(spark, "quarantine")
    quarantine.write(grids.unionByName(events), path, shape=(N, N))
    good, rejected = quarantine.tables(spark, path)
    return good.select("field", "design_id", F.lit("good").alias("reason"), F.size("values").alias("n")).unionByName(rejected.select("field", "design_id", "reason", F.lit(0).alias("n")))


def generated(spark, d, attempt: int):
    """The fields of some designs as a run makes them: in the first, grids of label 9 are missing and of label 8 spoilt; in the second, those of label 9 whose design is even are missing again."""

    def run(designs: DataFrame) -> DataFrame:
        f = fields(spark, d).join(designs.select("design_id"), "design_id", "left_semi")
        f = f.where((F.col("label") != 9) | (F.lit(attempt) > 1) & (F.col("design_id") % 2 == 1))
        return f.withColumn("values", F.when((F.col("label") == 8) & (F.lit(attempt) == 1), F.transform("values", lambda v: v * float("nan"))).otherwise(F.col("values"))).drop("label")

    return run


def run_ledger(spark, d):
    """Two runs over all designs, the second over what the first left; the ledger's latest state of each."""
    ids, path = fields(spark, d).select("design_id").distinct(), files.scratch(spark, "runs")
    for attempt in (1, 2):
        runs.execute(ids, generated(spark, d, attempt), path, 3, FIELDS, max_attempts=2)
    return runs.latest(spark, path).select("design_id", "run", "attempts", "n_present", "state")


def run_fields(spark, d):
    """The grids of the designs that two runs have made whole, each from the run that did."""
    ids, path = fields(spark, d).select("design_id").distinct(), files.scratch(spark, "runs")
    for attempt in (1, 2):
        runs.execute(ids, generated(spark, d, attempt), path, 3, FIELDS, max_attempts=2)
    return as_cells(runs.whole_fields(spark, path))


def resume_worklist(spark, d):
    missing = assemble.missing_designs(expected(spark, d), present(spark, d))
    return rounded(designs(spark, d).join(missing, "design_id", "left_semi"))


def run_summary(spark, d):
    c = assemble.coverage(expected(spark, d), present(spark, d))
    state = F.when(F.col("n_present") == F.col("n_expected"), "ok").when(F.col("n_present") == 0, "failed").otherwise("pending")
    return c.groupBy(state.alias("state")).agg(F.count("*").alias("n_designs"), F.sum(F.col("n_expected") - F.col("n_present")).alias("n_missing"))


def mirror_sink(spark, d):
    path = files.scratch(spark, "mirrored")
    image = assemble.mirror(fields(spark, d).drop("label"), 3).where("phase_idx >= 3")
    for _ in range(2):  # a second run leaves the same files
        files.write_mirrored(image, path)
    return as_cells(spark.read.parquet(path))


def bucketed_pairs(spark, d):
    """Inputs and targets as two bucketed tables, paired without a shuffle: the mean squared difference of the channels that both have, a row a sample that has such."""
    s, tables = samples(spark, d), []
    for t in ("x", "y"):
        path = files.scratch(spark, f"bucketed-{t}")
        tables.append(files.write_bucketed(s.select("sample_ix", t), path, path.rsplit("/", 1)[1].replace("-", "_"), 16))
    pairs = tables[0].join(tables[1].hint("merge"), "sample_ix")
    e = pairs.select("sample_ix", squares("x", "y", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)).alias("e")).where(F.size("e") > 0)
    return e.select("sample_ix", F.size("e").alias("n"), F.round(added("e") / F.size("e"), 6).alias("mse"))


def squares(x: str, y: str, of):
    """of(a, b) for the cells of the channels that both have, as one array."""
    each = F.zip_with(x, y, lambda a, b: F.zip_with(a, b, of))  # null where a or b is
    return F.flatten(F.filter(each, lambda c: c.isNotNull()))


def added(values: str):
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def epoch_batches(spark, d):
    """The orders' batches in two epochs, by arithmetic on their numbers."""
    o = ordinals(spark, d)
    n = max(1, o.count())
    return o.withColumns({f"batch_{e}": F.floor(dataset.permuted(F.col("sample_ix"), n, SEED, e) / 32) for e in (0, 1)})


def magnitudes(spark, d):
    return magnitude_cells(samples(spark, d))


def magnitude_cells(s: DataFrame) -> DataFrame:
    flat = F.posexplode(F.zip_with(F.element_at("y", 1), F.element_at("y", 2), lambda a, b: grid.magnitude(a.cast("double"), b.cast("double"))))
    s = s.select("sample_ix", "design_id", "phase_idx", "n_a", flat.alias("at", "b"))
    return s.select("sample_ix", "design_id", "phase_idx", F.floor(F.col("at") / F.col("n_a")).cast("int").alias("ir"), (F.col("at") % F.col("n_a")).cast("int").alias("ia"), near("b"))


def head_sample_magnitude(spark, d):
    return magnitude_cells(samples(spark, d).orderBy("sample_ix").limit(1)).select("ir", "ia", "b")


def flat(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in ("re", "im", "v")], *[near(c, 6) for c in ("re", "im", "v") if c in df.columns])


def mixed_modes(spark, d):
    return spectral.mix(low(spark, d).where("ch < 2"), weights(spark), N, RANKS["m1"])


def pointwise_mix(spark, d):
    w = spark.createDataFrame([(0, 0, 0.5), (1, 0, -0.25), (2, 0, 1.0), (3, 0, 2.0), (0, 1, 1.5), (1, 1, 0.75), (2, 1, -1.0), (3, 1, 0.125)], "ch int, ch_out int, w double")
    b = spark.createDataFrame([(0, 0.1), (1, -0.2)], "ch_out int, b double")
    return flat(spectral.pointwise(channels(spark, d), w, b))


def spectral_fit(spark, d):
    s = spectra(spark, d)
    f = spectral.fit(s.where("ch = 0"), s.where("ch = 2"))
    return f.select("kx", "ky", "n", near("wr", 6), near("wi", 6))


def spectral_fit_two(spark, d):
    s = spectra(spark, d)
    f = spectral.fit_two(s.where("ch = 0"), s.where("ch = 1"), s.where("ch = 2"))
    return f.select("kx", "ky", "n", *[near(c, 6) for c in ("w1r", "w1i", "w2r", "w2i")])


def spectral_fit_many(spark, d):
    """Three channels' weights to the fourth."""
    s = spectra(spark, d)
    f = spectral.fit_many(s, s.where("ch = 3"), [0, 1, 2])
    return f.select("kx", "ky", "n", "ch", near("wr", 6), near("wi", 6))


def doubles(spark, d) -> DataFrame:
    return samples(spark, d).withColumn("x", F.col("x").cast("array<array<double>>"))


def out_cells(arrays: DataFrame, column: str = "out", holes: bool = False) -> DataFrame:
    """The cells of the channels. A null channel has no rows, or, with holes, rows whose v is null."""
    if holes:
        arrays = arrays.withColumn(column, F.transform(column, lambda c: F.coalesce(c, F.array_repeat(F.lit(None).cast("double"), F.col("n_r") * F.col("n_a")))))
    a = arrays.select("sample_ix", "n_a", F.posexplode(column).alias("ch", "_v")).select("sample_ix", "ch", "n_a", F.posexplode("_v").alias("_at", "v"))
    return flat(a.select("sample_ix", "ch", F.floor(F.col("_at") / F.col("n_a")).cast("int").alias("ir"), (F.col("_at") % F.col("n_a")).cast("int").alias("ia"), "v"))


def rfft2_rows(spark, d):
    """Spectra of the samples' channels, each in its sample's row."""
    s = spectral.rows_spectra(samples(spark, d), N, N)
    s = s.select("sample_ix", F.posexplode("spectra").alias("ch", "_s")).select("sample_ix", "ch", F.posexplode("_s").alias("kx", "_s")).select("sample_ix", "ch", "kx", F.posexplode("_s").alias("ky", "_z"))
    return flat(s.select("sample_ix", "ch", "kx", "ky", "_z.re", "_z.im"))


def irfft2_rows(spark, d):
    """Cells of the mixed modes, which are no grid's own spectrum, each channel in a row."""
    s = spectral.dense_spectra(mixed_modes(spark, d), N, N)
    s = s.select("sample_ix", "ch", F.posexplode(spectral.row_values(F.col("spectrum"), N, N)).alias("_at", "v"))
    return flat(s.select("sample_ix", "ch", F.floor(F.col("_at") / N).cast("int").alias("ir"), (F.col("_at") % N).cast("int").alias("ia"), "v"))


def channel_layers(spark, d):
    """Two layers with activation between, the same in each cell."""
    return out_cells(spectral.mapped(doubles(spark, d), lambda x: spectral.dense(x, LAYERS)), holes=True)


def residual_block(spark, d):
    w1, w2 = spectral.block_arrays(weights(spark))
    there = doubles(spark, d).where(F.exists("x", lambda c: c.isNotNull()))  # else it has no spectrum
    return out_cells(spectral.mapped(there, lambda x: spectral.residual_block(x, w1, w2, BYPASS)), holes=True)


def operator_score(spark, d):
    """The seeded, untrained operator over all samples: the mean squared difference from y of the n cells of the channels that there are, a row a sample; null where there are none."""
    s = samples(spark, d)
    out = spectral.score(s, spectral.operator_weights(2, 2, N, N, SEED))
    e = s.select("sample_ix", "y").join(out.select("sample_ix", "out"), "sample_ix").select("sample_ix", squares("out", "y", lambda a, b: (a - b).cast("double") * (a - b)).alias("e"))
    return e.select("sample_ix", F.size("e").alias("n"), F.when(F.size("e") > 0, added("e") / F.size("e")).alias("mse"))


def stream_completeness(spark, d):
    at = files.scratch(spark, "stream")
    keys = present(spark, d).select("design_id", "phase_idx", "field")
    keys.repartition(4).write.parquet(f"{at}/in")
    return ingest.drain(spark, f"{at}/in", keys.schema, 12, f"{at}/out", f"{at}/checkpoint")


def stream_versions(spark, d):
    """Grids that arrive a minute after the other; half an hour later those of label 9 are withdrawn, and of these again some put back."""
    at = files.scratch(spark, "versions")
    e = table(spark, d, "embeddings")
    minute = lambda m: F.timestamp_seconds(F.lit(1_700_000_000) + m * 60)
    own = e.select("vec_id", "label", F.floor(F.col("vec_id") / 12).alias("design_id"), (F.floor(F.col("vec_id") / 4) % 3).cast("int").alias("phase_idx"), F.element_at(F.array(*[F.lit(x) for x in FIELDS]), (F.col("vec_id") % 4).cast("int") + 1).alias("field"))
    put, lost, again = (F.struct(F.lit(a).alias("action"), minute(F.col("vec_id") + k).alias("ts")) for a, k in (("put", 0), ("withdraw", 30), ("put", 45)))
    steps = F.when(F.col("label") != 9, F.array(put)).when(F.col("vec_id") % 2 == 0, F.array(put, lost)).otherwise(F.array(again, put, lost, put))
    rows = own.select("design_id", "phase_idx", "field", F.inline(steps))
    most = e.agg(F.max("vec_id")).collect()[0][0] or 0
    for k in range(3):  # files arrive in order of time, a third each
        lo, hi = (minute(F.lit((most + 46) * x // 3)) for x in (k, k + 1))
        rows.where((F.col("ts") >= lo) & (F.col("ts") < hi)).write.mode("append").parquet(f"{at}/in")
    return versions.drain(spark, f"{at}/in", 12, f"{at}/out", f"{at}/checkpoint", files_at_once=1000)


def queries() -> dict:
    f = F.col
    return {
        "uniform_draw": lambda s, d: design_ids(s, d).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(11)))).withColumn("u", draws.uniform01(SEED, f("design_id"), f("draw"))),
        "triangular_draw": lambda s, d: design_ids(s, d).withColumn("v", draws.triangular(draws.uniform01(SEED, f("design_id"), 1), F.lit(5.0), F.lit(10.0), F.lit(7.125))),
        "design_sample": lambda s, d: rounded(designs(s, d)),
        "phase_draw": lambda s, d: phases(s, d).select("design_id", "phase_idx", near("phase_deg")),
        "slot_opening_angle": lambda s, d: regions.with_radii(designs(s, d)).withColumn("opening_deg", F.degrees("opening_rad")).select("design_id", near("opening_deg", 6), near("chord", 6)),
        "design_lookup": lambda s, d: table(s, d, "lineitem").join(designs(s, d), f("l_partkey") == f("design_id")).select("l_orderkey", "l_linenumber", "design_id", near("stator_outer_diameter"), near("pole_thickness")),
        "polar_grid": lambda s, d: grid.with_cells(designs(s, d), AVERAGES).select("design_id", "ir", "ia", near("r"), near("th")),
        "polar_xy": lambda s, d: grid.cartesian(grid.with_cells(designs(s, d), AVERAGES)).select("design_id", "ir", "ia", near("x", 6), near("y", 6)),
        "grid_corners": grid_corners,
        "back_iron_mask": counted(lambda: regions.back_iron(f("r"))),
        "pole_sector": lambda s, d: raster.cells_of(phases(s, d), CODES).groupBy("design_id", "phase_idx").agg(F.count_if("pole_p").alias("n_p"), F.count_if("pole_n").alias("n_n")),
        "coil_mask": counted(lambda: f("copper")),
        "stator_mask": counted(lambda: regions.stator(f("r"), f("phi"), f("sx"), f("copper"))),
        "material_grid": material_grid,
        "material_arrays": material_arrays,
        "air_gap_mask": lambda s, d: raster.air_gap(phases(s, d), CODES).groupBy("design_id", "phase_idx").agg(F.count_if("in_gap").alias("n")),
        "material_property_join": material_property_join,
        "mu_avg_grid": lambda s, d: raster.averages(shares(s, d)).select("design_id", "phase_idx", "ir", "ia", near("mu_avg")),
        "magnetization_grid": lambda s, d: raster.averages(shares(s, d)).select("design_id", "phase_idx", "ir", "ia", (f("magnetization") + 0.0).alias("magnetization")),
        "refined_averages": refined_averages,
        "area_fractions": area_fractions,
        "sample_arrays": sample_arrays,
        "field_resample": field_resample,
        "field_filled": field_filled,
        "design_csv_roundtrip": design_csv_roundtrip,
        "matrix_csv_roundtrip": matrix_csv_roundtrip,
        "field_parquet_roundtrip": field_parquet_roundtrip,
        "tensor_roundtrip": tensor_roundtrip,
        "file_listing": file_listing,
        "key_parse": key_parse,
        "grid_quarantine": grid_quarantine,
        "quarantine_tables": quarantine_tables,
        "run_ledger": run_ledger,
        "run_fields": run_fields,
        "explode_grid": lambda s, d: as_cells(fields(s, d)),
        "missing_designs": lambda s, d: assemble.missing_designs(expected(s, d), present(s, d)),
        "coverage_report": lambda s, d: assemble.coverage(expected(s, d), present(s, d)),
        "expected_except_present": lambda s, d: assemble.expected_except_present(expected(s, d), present(s, d)),
        "mirror_augment": lambda s, d: as_cells(assemble.mirror(fields(s, d).drop("label"), 3)),
        "mirror_sink": mirror_sink,
        "assemble_tensor": lambda s, d: tensor_cells(samples(s, d)),
        "dataset_shape": lambda s, d: dataset.shape(samples(s, d)),
        "resume_worklist": resume_worklist,
        "run_summary": run_summary,
        "sample_ordinal": ordinals,
        "split_train_test": lambda s, d: dataset.split(ordinals(s, d)),
        "minibatches": lambda s, d: dataset.minibatches(lines(s, d), SEED, 0).select("sample_ix", "batch_id"),
        "bucketed_pairs": bucketed_pairs,
        "epoch_batches": epoch_batches,
        "mse": lambda s, d: dataset.mse(lines(s, d)).select("n", F.round("mse", 2).alias("mse")),
        "epoch_loss": lambda s, d: dataset.epoch_loss(dataset.minibatches(lines(s, d), SEED, 0)).select("n_batches", F.round("epoch_loss", 2).alias("epoch_loss")),
        "field_order": lambda s, d: assemble.dense_ordinal(fields(s, d).select(*assemble.KEYS), assemble.KEYS, "position"),
        "param_count": lambda s, d: dataset.parameter_count(dataset.grid_shapes(fields(s, d), 2, 2)),
        "head_sample_magnitude": head_sample_magnitude,
        "field_magnitude": lambda s, d: magnitudes(s, d).drop("sample_ix"),
        "rfft2": lambda s, d: flat(spectra(s, d)),
        "rfft2_batches": lambda s, d: flat(spectral.rfft2(doubles(s, d))),
        "rfft2_rows": rfft2_rows,
        "irfft2_rows": irfft2_rows,
        "mode_truncate": lambda s, d: flat(low(s, d)),
        "spectral_mix": lambda s, d: flat(mixed_modes(s, d)),
        "irfft2": lambda s, d: flat(spectral.inverse(spectra(s, d), N, N)),
        "spectral_conv": lambda s, d: flat(spectral.convolve(channels(s, d).where("ch < 2"), weights(s), N, N, RANKS["m1"], RANKS["m2"])),
        "pointwise_mix": pointwise_mix,
        "irfft2_batches": lambda s, d: out_cells(spectral.irfft2(spectral.spectra_arrays(doubles(s, d))), "x"),
        "spectral_conv_batches": lambda s, d: out_cells(spectral.convolve_batches(doubles(s, d), *spectral.block_arrays(weights(s)))),
        "channel_layers": channel_layers,
        "residual_block": residual_block,
        "spectral_fit": spectral_fit,
        "spectral_fit_two": spectral_fit_two,
        "spectral_fit_many": spectral_fit_many,
        "gelu": lambda s, d: spectral.with_gelu(channels(s, d), "v", "g").withColumn("g", F.round("g", 6) + 0.0),
        "operator_score": operator_score,
        "stream_completeness": stream_completeness,
        "stream_versions": stream_versions,
    }
