"""Two-dimensional spectra of gridded channels, spectral convolution, batch scoring and a closed-form fit.

Relational forms (cells: sample_ix, ch, ir, ia, v; spectra: sample_ix, ch, kx, ky, re, im)
suit few modes and serve as checks; full grids go through Arrow batches and numpy's FFT.
Tables of twiddles and weights have a size fixed by the grid and the modes.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import uniform01

SPECTRUM = "sample_ix long, ch int, kx int, ky int, re double, im double"


def twiddles(spark: SparkSession, n: int, modes: int, place: str, mode: str) -> DataFrame:
    """place, mode, c, s: cos and sin of 2 pi place mode / n, of one axis; n x modes rows, by the grid."""
    d = spark.range(n * modes).select((F.col("id") % modes).cast("int").alias(mode), F.floor(F.col("id") / modes).cast("int").alias(place))
    # whole turns are taken off in integers, so that the angle is exact to a rounding
    angle = (F.col(place) * F.col(mode)) % n * F.lit(2 * math.pi / n)
    return F.broadcast(d.withColumns({"c": F.cos(angle), "s": F.sin(angle)}))


def forward(cells: DataFrame, n_r: int, n_a: int) -> DataFrame:
    """Real two-dimensional DFT over the half spectrum: an axis after the other, each a join with its twiddles and sums that combine before the shuffle."""
    spark, c, s = cells.sparkSession, F.col("c"), F.col("s")
    d = cells.join(twiddles(spark, n_a, n_a // 2 + 1, "ia", "ky"), "ia").groupBy("sample_ix", "ch", "ir", "ky").agg(F.sum(F.col("v") * c).alias("a"), (-F.sum(F.col("v") * s)).alias("b"))
    d = d.join(twiddles(spark, n_r, n_r, "ir", "kx"), "ir")
    return d.groupBy("sample_ix", "ch", "kx", "ky").agg(F.sum(F.col("a") * c + F.col("b") * s).alias("re"), F.sum(F.col("b") * c - F.col("a") * s).alias("im"))


def inverse(spectra: DataFrame, n_r: int, n_a: int) -> DataFrame:
    """Inverse of the half spectrum, an axis after the other; modes without a row are 0. Modes 0 and n_a / 2 count once and by their real part, as the others' mirror images count too."""
    spark, c, s = spectra.sparkSession, F.col("c"), F.col("s")
    d = spectra.join(twiddles(spark, n_r, n_r, "ir", "kx"), "kx")
    d = d.groupBy("sample_ix", "ch", "ir", "ky").agg(F.sum(F.col("re") * c - F.col("im") * s).alias("a"), F.sum(F.col("re") * s + F.col("im") * c).alias("b"))
    times = F.when((F.col("ky") == 0) | (F.col("ky") * 2 == n_a), 1.0).otherwise(2.0)
    d = d.join(twiddles(spark, n_a, n_a // 2 + 1, "ia", "ky"), "ky")
    return d.groupBy("sample_ix", "ch", "ir", "ia").agg((F.sum(times * (F.col("a") * c - F.col("b") * s)) / (n_r * n_a)).alias("v"))


def truncate(spectra: DataFrame, n_r: int, n_a: int, m1: int, m2: int) -> DataFrame:
    """The low modes with their block: 1 at the low end of the first axis, 2 at its high end, which wins where they overlap."""
    m1, m2 = min(m1, n_r), min(m2, n_a // 2 + 1)
    low = spectra.where((F.col("ky") < m2) & ((F.col("kx") < m1) | (F.col("kx") >= n_r - m1)))
    return low.withColumn("block", F.when(F.col("kx") >= n_r - m1, 2).otherwise(1))


def block_row(n_r: int, m1: int) -> Column:
    """A mode's row within its block's weights."""
    return F.when(F.col("block") == 2, F.col("kx") - (n_r - m1)).otherwise(F.col("kx"))


def seeded_weights(spark: SparkSession, c_in: int, c_out: int, m1: int, m2: int, seed: int, layer: int = 0) -> DataFrame:
    """layer, block, ch_in, ch_out, wx, ky, wr, wi: both blocks' complex weights, uniform in [0, 1)."""
    n = 2 * c_in * c_out * m1 * m2
    d = spark.range(n).select(
        F.col("id"), F.lit(layer).alias("layer"), (F.col("id") % m2).cast("int").alias("ky"), (F.floor(F.col("id") / m2) % m1).cast("int").alias("wx"), (F.floor(F.col("id") / (m2 * m1)) % c_out).cast("int").alias("ch_out"),
        (F.floor(F.col("id") / (m2 * m1 * c_out)) % c_in).cast("int").alias("ch_in"), (F.floor(F.col("id") / (m2 * m1 * c_out * c_in)) + 1).cast("int").alias("block"),
    )
    at = F.concat_ws("-", F.lit(str(layer)), F.col("id").cast("string"))
    return d.withColumns({"wr": uniform01(seed, at, 1), "wi": uniform01(seed, at, 2)}).drop("id")


def mix(truncated: DataFrame, weights: DataFrame, n_r: int, m1: int) -> DataFrame:
    """Complex products with the weights, summed over the channels that go in."""
    t = truncated.withColumn("wx", block_row(n_r, min(m1, n_r))).withColumnRenamed("ch", "ch_in")
    d = t.join(F.broadcast(weights), ["block", "ch_in", "wx", "ky"])  # 2 c_in c_out m1 m2 rows
    re, im = F.col("re") * F.col("wr") - F.col("im") * F.col("wi"), F.col("re") * F.col("wi") + F.col("im") * F.col("wr")
    return d.groupBy("sample_ix", F.col("ch_out").alias("ch"), "kx", "ky").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def convolve(cells: DataFrame, weights: DataFrame, n_r: int, n_a: int, m1: int, m2: int) -> DataFrame:
    """Spectral convolution: forward, truncate, mix, inverse."""
    return inverse(mix(truncate(forward(cells, n_r, n_a), n_r, n_a, m1, m2), weights, n_r, m1), n_r, n_a)


def pointwise(cells: DataFrame, weights: DataFrame, biases: DataFrame) -> DataFrame:
    """An affine map of the channels, the same in each cell. weights: ch, ch_out, w; biases: ch_out, b."""
    d = cells.join(F.broadcast(weights), "ch").groupBy("sample_ix", "ir", "ia", "ch_out").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    return d.join(F.broadcast(biases), "ch_out").select("sample_ix", F.col("ch_out").alias("ch"), "ir", "ia", (F.col("s") + F.col("b")).alias("v"))


def fit(x: DataFrame, y: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """kx, ky, n, wr, wi: for each mode, the complex weight that takes the spectra x to y with least squared error.

    A linear surrogate for training, not a trained network: w = sum(y conj(x)) / (sum |x|^2 + ridge).
    """
    d = x.select("sample_ix", "kx", "ky", F.col("re").alias("a"), F.col("im").alias("b")).join(y.select("sample_ix", "kx", "ky", F.col("re").alias("c"), F.col("im").alias("d")), ["sample_ix", "kx", "ky"])
    a, b, c, e = (F.col(k) for k in "abcd")
    s = d.groupBy("kx", "ky").agg(F.count("*").alias("n"), F.sum(a * a + b * b).alias("xx"), F.sum(c * a + e * b).alias("re"), F.sum(e * a - c * b).alias("im"))
    return s.select("kx", "ky", "n", (F.col("re") / (F.col("xx") + ridge)).alias("wr"), (F.col("im") / (F.col("xx") + ridge)).alias("wi"))


def fit_two(x1: DataFrame, x2: DataFrame, y: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """kx, ky, n, w1r, w1i, w2r, w2i: for each mode, the complex weights of two channels whose sum is nearest to y.

    The 2 x 2 normal equations in closed form, with ridge on their diagonal: sums of
    products, then the inverse in columns.
    """
    at = ["sample_ix", "kx", "ky"]
    part = lambda d, k: d.select(*at, F.col("re").alias(f"{k}r"), F.col("im").alias(f"{k}i"))
    d = part(x1, "a").join(part(x2, "b"), at).join(part(y, "y"), at)
    c = F.col
    # of u conj(v)
    re, im = lambda u, v: c(f"{u}r") * c(f"{v}r") + c(f"{u}i") * c(f"{v}i"), lambda u, v: c(f"{u}i") * c(f"{v}r") - c(f"{u}r") * c(f"{v}i")
    sums = {"aa": re("a", "a"), "bb": re("b", "b"), "pr": re("b", "a"), "pi": im("b", "a"), "ur": re("y", "a"), "ui": im("y", "a"), "vr": re("y", "b"), "vi": im("y", "b")}
    s = d.groupBy("kx", "ky").agg(F.count("*").alias("n"), *[F.sum(x).alias(k) for k, x in sums.items()])
    # w1 (aa + ridge) + w2 p = u and w1 conj(p) + w2 (bb + ridge) = v
    aa, bb, pr, pi = c("aa") + ridge, c("bb") + ridge, c("pr"), c("pi")
    det = aa * bb - pr * pr - pi * pi
    out = {"w1r": bb * c("ur") - (pr * c("vr") - pi * c("vi")), "w1i": bb * c("ui") - (pr * c("vi") + pi * c("vr")), "w2r": aa * c("vr") - (pr * c("ur") + pi * c("ui")), "w2i": aa * c("vi") - (pr * c("ui") - pi * c("ur"))}
    return s.select("kx", "ky", "n", *[(x / det).alias(k) for k, x in out.items()])


def fit_many(x: DataFrame, y: DataFrame, channels: list[int], ridge: float = 1e-6) -> DataFrame:
    """kx, ky, n, ch, wr, wi: for each mode, the complex weights of the channels whose sum is nearest to the spectra y.

    One shuffle brings a sample's channels together, of which it needs all; Gram matrices
    and right sides are sums by mode, with partial sums before their shuffle. The Hermitian
    equations, with ridge on the diagonal, are solved over arrays in the mode's row; as the
    matrix is positive definite no rows change places.
    """
    n, at = len(channels), ["sample_ix", "kx", "ky"]
    number = F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("ch")).cast("int") - 1
    own = x.where(F.col("ch").isin(channels)).select(*at, number.alias("k"), "re", "im").unionByName(y.select(*at, F.lit(n).alias("k"), "re", "im"))
    d = own.groupBy(*at).agg(*[F.max(F.when(F.col("k") == k, F.struct("re", "im"))).alias(f"z{k}") for k in range(n + 1)]).dropna(subset=[f"z{k}" for k in range(n + 1)])
    # of u conj(v)
    re, im = lambda u, v: F.col(f"{u}.re") * F.col(f"{v}.re") + F.col(f"{u}.im") * F.col(f"{v}.im"), lambda u, v: F.col(f"{u}.im") * F.col(f"{v}.re") - F.col(f"{u}.re") * F.col(f"{v}.im")
    pairs = [(i, j) for i in range(n) for j in range(i, n + 1)]
    s = d.groupBy("kx", "ky").agg(F.count("*").alias("n"), *[f(part(f"z{j}", f"z{i}")).alias(f"{name}{i}_{j}") for f, i, j in [(F.sum, i, j) for i, j in pairs] for name, part in (("r", re), ("i", im))])

    def entry(i, j):
        a, b = min(i, j), max(i, j)
        return F.struct((F.col(f"r{a}_{b}") + (ridge if i == j else 0.0)).alias("re"), (F.col(f"i{a}_{b}") * (1.0 if i <= j else -1.0)).alias("im"))

    def turn(rows, p):
        pivot = F.get(F.get(rows, p), p)
        size = pivot["re"] * pivot["re"] + pivot["im"] * pivot["im"]
        scaled = F.transform(F.get(rows, p), lambda z: F.struct(((z["re"] * pivot["re"] + z["im"] * pivot["im"]) / size).alias("re"), ((z["im"] * pivot["re"] - z["re"] * pivot["im"]) / size).alias("im")))

        def less(row, own):
            f = F.get(row, p)
            return F.zip_with(row, own, lambda a, b: F.struct((a["re"] - (f["re"] * b["re"] - f["im"] * b["im"])).alias("re"), (a["im"] - (f["re"] * b["im"] + f["im"] * b["re"])).alias("im")))

        return _held(scaled, lambda own: F.transform(rows, lambda row, i: F.when(i == p, own).otherwise(less(row, own))))

    rows = F.array(*[F.array(*[entry(i, j) for j in range(n + 1)]) for i in range(n)])
    solved = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, turn)
    w = s.select("kx", "ky", "n", F.posexplode(F.transform(solved, lambda row: F.get(row, F.lit(n)))).alias("_k", "_w"))
    return w.select("kx", "ky", "n", F.get(F.array(*[F.lit(c) for c in channels]), F.col("_k")).alias("ch"), F.col("_w.re").alias("wr"), F.col("_w.im").alias("wi"))


# ------------------------------------------------------------------ in a sample's row


def steps(n: int, sign: int) -> list[list[list[tuple]]]:
    """The butterflies of a transform of n elements, a prime factor of n a step: for each element the (source, cos, sin) of what is summed.

    After the factors of l, element k r + j (r = n / l) is mode k of the l elements
    j, j + r, j + 2 r...; so the next step takes its sources in order, and none has to be
    put in reversed order first.
    """
    out, done, rest = [], 1, n
    while rest > 1:
        p = next(f for f in range(2, rest + 1) if rest % f == 0)
        new, left = done * p, rest // p
        step = []
        for k in range(new):
            turns = [2 * math.pi * (q * k % new) / new for q in range(p)]
            step += [[((k % done) * rest + j + q * left, math.cos(t), sign * math.sin(t)) for q, t in enumerate(turns)] for j in range(left)]
        out.append(step)
        done, rest = new, left
    return out


def _held(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def butterflies(rows: Column, n: int, sign: int) -> Column:
    """The discrete transform over the first axis of n rows of complex numbers (re, im): sign -1 forward, 1 inverse without the division by n."""

    def step_of(step):
        # a constant that Spark reads once; as many expressions would take far longer to plan
        named = [{f"{k}{q}": x for q, part in enumerate(e) for k, x in zip(("at", "c", "s"), part)} for e in step]
        kind = ", ".join(f"at{q}: int, c{q}: double, s{q}: double" for q in range(len(step[0])))
        plan = F.from_json(F.lit(json.dumps(named)), f"array<struct<{kind}>>")

        def added(total, row, c, s):
            return F.zip_with(total, row, lambda a, b: F.struct((a["re"] + b["re"] * c - b["im"] * s).alias("re"), (a["im"] + b["re"] * s + b["im"] * c).alias("im")))

        def element(rows, e):
            total = F.get(rows, e["at0"])
            for q in range(1, len(step[0])):
                total = added(total, F.get(rows, e[f"at{q}"]), e[f"c{q}"], e[f"s{q}"])
            return total

        return lambda rows: F.transform(plan, lambda e: element(rows, e))

    for step in steps(n, sign):
        rows = _held(rows, step_of(step))
    return rows


def turned_over(rows: Column, n: int) -> Column:
    """Rows of n elements as columns."""
    return _held(rows, lambda held: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.transform(held, lambda row: F.get(row, j))))


def row_spectrum(values: Column, n_r: int, n_a: int) -> Column:
    """The half spectrum of a row-major array: n_r rows (kx) of n_a // 2 + 1 complex numbers (ky), in the JVM and in the row. A null array has a null spectrum."""
    complexes = F.transform(F.sequence(F.lit(0), F.lit(n_a - 1)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(n_r - 1)), lambda i: F.struct(F.get(values, i * n_a + j).cast("double").alias("re"), F.lit(0.0).alias("im"))))
    half = F.slice(butterflies(complexes, n_a, -1), 1, n_a // 2 + 1)
    return F.when(values.isNotNull(), butterflies(turned_over(half, n_r), n_r, -1))


def row_values(spectrum: Column, n_r: int, n_a: int) -> Column:
    """The row-major array of a half spectrum: row_spectrum's inverse. Of modes 0 and n_a / 2 the real part counts once they are back in places of r, as their images are themselves."""
    n = n_a // 2 + 1
    columns = turned_over(butterflies(spectrum, n_r, 1), n)
    conj = lambda c, by: F.transform(c, lambda z: F.struct(z["re"].alias("re"), (z["im"] * by).alias("im")))

    def whole(half):
        own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: conj(F.get(half, k), F.when((k == 0) | (k * 2 == n_a), 0.0).otherwise(1.0)))
        if n_a < 3:
            return own
        return F.concat(own, F.transform(F.sequence(F.lit(n), F.lit(n_a - 1)), lambda k: conj(F.get(half, F.lit(n_a) - k), F.lit(-1.0))))

    back = butterflies(_held(columns, whole), n_a, 1)
    return F.when(spectrum.isNotNull(), F.flatten(F.transform(turned_over(back, n_r), lambda row: F.transform(row, lambda z: z["re"] / (n_r * n_a)))))


def rows_spectra(samples: DataFrame, n_r: int, n_a: int, column: str = "x") -> DataFrame:
    """samples with spectra: each channel's half spectrum, computed in the sample's row, without a shuffle or Python."""
    return samples.withColumn("spectra", F.transform(column, lambda x: row_spectrum(x, n_r, n_a)))


def dense_spectra(spectra: DataFrame, n_r: int, n_a: int) -> DataFrame:
    """sample_ix, ch, spectrum: the modes' rows as one array each, 0 where a mode has no row; one shuffle."""
    n = n_a // 2 + 1
    held = spectra.groupBy("sample_ix", "ch").agg(F.map_from_entries(F.collect_list(F.struct((F.col("kx") * n + F.col("ky")).alias("k"), F.struct("re", "im").alias("z")))).alias("_m"))
    none = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    row = lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.try_element_at("_m", i * n + j), none))
    return held.select("sample_ix", "ch", F.transform(F.sequence(F.lit(0), F.lit(n_r - 1)), row).alias("spectrum"))


# ------------------------------------------------------------------ Arrow batches


def _stacks(batch, column: str):
    """The channel arrays of a batch, by shape: (row numbers, array of rows x channels x n_r x n_a, whether a channel is null, rows x channels). A null channel is NaN throughout."""
    import numpy as np

    shapes: dict = {}
    rows = batch.column(batch.schema.names.index(column)).to_pylist()
    n_r, n_a = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("n_r", "n_a"))
    for i, (x, a, b) in enumerate(zip(rows, n_r, n_a)):
        shapes.setdefault((len(x), a, b), []).append(i)
    for (c, a, b), own in shapes.items():
        none, nan = np.array([[v is None for v in rows[i]] for i in own], bool).reshape(len(own), c), [math.nan] * (a * b)
        yield own, np.array([[nan if v is None else v for v in rows[i]] for i in own], float).reshape(len(own), c, a, b), none


def rfft2(samples: DataFrame, column: str = "x") -> DataFrame:
    """Spectra of all channels of array samples (sample_ix, n_r, n_a, column); a null channel has no rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ix = batch.column(batch.schema.names.index("sample_ix")).to_numpy()
            for own, x, none in _stacks(batch, column):
                s, ch = np.nonzero(~none)
                f = np.fft.rfft2(x[s, ch])
                at, kx, ky = (k.ravel() for k in np.indices(f.shape))
                f = f.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(ix[own][s[at]]), *[pa.array(k.astype("int32")) for k in (ch[at], kx, ky)], pa.array(f.real.copy()), pa.array(f.imag.copy())], names=["sample_ix", "ch", "kx", "ky", "re", "im"])

    return samples.select("sample_ix", "n_r", "n_a", column).mapInArrow(run, SPECTRUM)


def erf(x):
    """Vectorised error function, to double precision: its series near 0, its continued fraction beyond."""
    import numpy as np

    x = np.asarray(x, float)
    a = np.abs(x)
    small = np.minimum(a, 3.0)
    term, total = small.copy(), small.copy()
    for n in range(1, 60):
        term = term * (-small * small) / n
        total = total + term / (2 * n + 1)
    big, tail = np.maximum(a, 3.0), np.zeros_like(a)
    for n in range(60, 0, -1):
        tail = (n / 2) / (big + tail)
    far = 1 - np.exp(-big * big) / math.sqrt(math.pi) / (big + tail)
    return np.sign(x) * np.where(a < 3, total * 2 / math.sqrt(math.pi), far)


def gelu(x):
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def erf_column(x: Column) -> Column:
    """erf as columns: the series below 3, nested so that each power is made once, and the continued fraction beyond, from its 60th term up."""
    a, z = F.abs(x), x * x
    total = F.lit(0.0)
    for n in range(60, 0, -1):
        # term n over term n - 1 is -z (2n - 1) / (n (2n + 1))
        total = (total + 1) * z * (-(2 * n - 1) / (n * (2 * n + 1)))
    near = x * (total + 1) * (2 / math.sqrt(math.pi))
    tail = F.lit(0.0)
    for n in range(60, 0, -1):
        tail = F.lit(n / 2) / (a + tail)
    return F.when(a < 3, near).when(a >= 6, F.signum(x)).otherwise(F.signum(x) * (1 - F.exp(-z) / math.sqrt(math.pi) / (a + tail)))


def with_gelu(rows: DataFrame, column: str, out: str) -> DataFrame:
    """x (1 + erf(x / sqrt 2)) / 2, in the plan: no Python. Null and NaN stay."""
    x = F.col(column).cast("double")
    held = rows.withColumn("_t", x / math.sqrt(2))
    return held.withColumn(out, 0.5 * x * (1 + erf_column(F.col("_t")))).drop("_t")


def operator_weights(c_in: int, c_out: int, n_r: int, n_a: int, seed: int = 0, **sizes) -> dict:
    """Seeded weights of a whole operator, by name; spectral ones are complex."""
    import numpy as np

    from .dataset import operator_shapes

    rng, out = np.random.default_rng(seed), {}
    for name, shape in operator_shapes(c_in, c_out, n_r, n_a, **sizes):
        w = rng.uniform(-1, 1, shape) / math.sqrt(max(1, shape[-1]))
        out[name] = w + 1j * rng.uniform(-1, 1, shape) / math.sqrt(max(1, shape[-1])) if name.startswith("spectral") else w
    return out


def layers_of(weights: dict, name: str) -> list[tuple]:
    """(weight, bias) of each layer of that name."""
    n = sum(k.startswith(f"{name}.") and k.endswith("weight") for k in weights)
    return [(weights[f"{name}.{i}.weight"], weights[f"{name}.{i}.bias"]) for i in range(n)]


def dense(x, layers: list[tuple], act=gelu):
    """Affine maps of the channels, the same in each cell, with act between them; a single one has it too, if act is given."""
    import numpy as np

    for i, (w, b) in enumerate(layers):
        x = np.einsum("oc,bcij->boij", w, x) + np.asarray(b)[None, :, None, None]
        if act and (len(layers) == 1 or i < len(layers) - 1):
            x = act(x)
    return x


def spectral_layer(x, w1, w2):
    """The low modes of each channel times complex weights (in x out x m1 x m2), summed over the channels: w1 at the low end of the first axis, w2 at its high end, which wins where they overlap."""
    import numpy as np

    n_r, n_a = x.shape[2:]
    m1, m2 = w1.shape[2:]
    f = np.fft.rfft2(x)
    g = np.zeros((len(x), w1.shape[1], n_r, n_a // 2 + 1), complex)
    for part, w in ((slice(0, m1), w1), (slice(n_r - m1, n_r), w2)):
        g[:, :, part, :m2] = np.einsum("bixy,ioxy->boxy", f[:, :, part, :m2], w)
    return np.fft.irfft2(g, s=(n_r, n_a))


def residual_block(x, w1, w2, bypass: list[tuple], act=gelu):
    """A spectral layer beside an affine map of the channels, added and activated."""
    return act(spectral_layer(x, w1, w2) + dense(x, bypass, None))


def apply_operator(x, weights: dict):
    """Lift, spectral blocks with bypass and activation, projection: rows x channels x n_r x n_a to the same with the outgoing channels."""
    x, k = dense(x, layers_of(weights, "lift")), 0
    while f"spectral.{k}.w1" in weights:
        x = residual_block(x, weights[f"spectral.{k}.w1"], weights[f"spectral.{k}.w2"], layers_of(weights, f"bypass.{k}"))
        k += 1
    return dense(x, layers_of(weights, "project"))


def mapped(samples: DataFrame, function, column: str = "x", out: str = "out", element: str = "double") -> DataFrame:
    """sample_ix, n_r, n_a and out: function of the channels of array samples, rows x channels x n_r x n_a at a time, in Arrow batches. A channel of the result that a null channel goes into is null."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.list_(pa.float32() if element == "float" else pa.float64()))
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                ix, n_r, n_a = (part.column(part.schema.names.index(c)) for c in ("sample_ix", "n_r", "n_a"))
                for own, x, none in _stacks(part, column):
                    y, at = function(x), pa.array(own)
                    y = y.reshape(*y.shape[:2], -1)
                    made = y.tolist()
                    for i in np.flatnonzero(none.any(axis=1)):
                        made[i] = [None if np.isnan(y[i, c]).all() else v for c, v in enumerate(made[i])]
                    yield pa.RecordBatch.from_arrays([ix.take(at), n_r.take(at), n_a.take(at), pa.array(made, kind)], names=["sample_ix", "n_r", "n_a", out])

    return samples.select("sample_ix", "n_r", "n_a", column).mapInArrow(run, f"sample_ix long, n_r int, n_a int, {out} array<array<{element}>>")


def convolve_batches(samples: DataFrame, w1, w2, column: str = "x") -> DataFrame:
    """Spectral convolution of whole grids of any size; w1 and w2 are the blocks' complex weights, of a size fixed by the modes. As in convolve, a channel that isn't there adds nothing, and a sample without any has no result."""
    shared = samples.sparkSession.sparkContext.broadcast((w1, w2))
    nothing = F.array_repeat(F.lit(0.0), F.col("n_r") * F.col("n_a"))
    there = samples.where(F.exists(column, lambda c: c.isNotNull())).withColumn(column, F.transform(column, lambda c: F.coalesce(c, nothing.cast("array<double>"))))
    return mapped(there, lambda x: spectral_layer(x, *shared.value), column)


def block_arrays(weights: DataFrame) -> tuple:
    """(w1, w2), in x out x m1 x m2, of a table of weights; as many rows as the modes have."""
    import numpy as np

    rows = weights.select("block", "ch_in", "ch_out", "wx", "ky", "wr", "wi").toPandas()
    shape = [int(rows[c].max()) + 1 for c in ("ch_in", "ch_out", "wx", "ky")]
    out = np.zeros((2, *shape), complex)
    out[tuple(rows[c].to_numpy() - (c == "block") for c in ("block", "ch_in", "ch_out", "wx", "ky"))] = rows["wr"] + 1j * rows["wi"]
    return out[0], out[1]


def spectra_arrays(samples: DataFrame, column: str = "x") -> DataFrame:
    """sample_ix, n_r, n_a, and re and im of each channel's half spectrum, row-major arrays."""
    import numpy as np

    both = mapped(samples, lambda x: np.concatenate([(f := np.fft.rfft2(x)).real, f.imag], axis=1), column, "_both")
    half = F.floor(F.size("_both") / 2).cast("int")
    return both.select("sample_ix", "n_r", "n_a", F.slice("_both", 1, half).alias("re"), F.slice("_both", half + 1, half).alias("im"))


def irfft2(spectra: DataFrame, out: str = "x") -> DataFrame:
    """The channels of array spectra (sample_ix, n_r, n_a, re, im), the inverse of spectra_arrays; null where the spectrum is."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            col = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
            x = []
            for n_r, n_a, re, im in zip(col["n_r"], col["n_a"], col["re"], col["im"]):
                there = [c for c, v in enumerate(re) if v is not None]
                f = (np.array([re[c] for c in there], float) + 1j * np.array([im[c] for c in there], float)).reshape(len(there), n_r, n_a // 2 + 1)
                back = dict(zip(there, np.fft.irfft2(f, s=(n_r, n_a)).reshape(len(f), -1).tolist())) if there else {}
                x.append([back.get(c) for c in range(len(re))])
            keep = [batch.column(batch.schema.names.index(c)) for c in ("sample_ix", "n_r", "n_a")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(x, pa.list_(pa.list_(pa.float64())))], names=["sample_ix", "n_r", "n_a", out])

    return spectra.select("sample_ix", "n_r", "n_a", "re", "im").mapInArrow(run, f"sample_ix long, n_r int, n_a int, {out} array<array<double>>")


def score(samples: DataFrame, weights: dict, column: str = "x") -> DataFrame:
    """sample_ix, n_r, n_a and out, the operator's channels, in Arrow batches; the weights' size is fixed by the operator's, not by the data's."""
    shared = samples.sparkSession.sparkContext.broadcast(weights)
    return mapped(samples, lambda x: apply_operator(x, shared.value).astype("float32"), column, element="float")
