"""Polar grids: cells, corners, mirror images, arrays and magnitudes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """n_r x n_a cells between two radii (mm) and two angles (degrees)."""

    n_r: int = 80
    n_a: int = 240
    r_in: float = 27.5
    r_ext: float = 45.0
    ang_1: float = 0.0
    ang_2: float = 120.0

    @property
    def dr(self) -> float:
        return (self.r_ext - self.r_in) / self.n_r

    @property
    def da(self) -> float:
        return (self.ang_2 - self.ang_1) / self.n_a

    @property
    def disk(self) -> float:
        """The radius of a cell's averaging disk, as a share of r: a third of the angle between n_a + 1 parts."""
        import math

        return abs(math.radians(self.ang_2) - math.radians(self.ang_1)) / (self.n_a + 1) / 3


def with_cells(rows: DataFrame, g: Grid) -> DataFrame:
    """A row for each of the rows' cells, radius by radius: ir, ia, and the centre's r and th (degrees). No shuffle."""
    d = rows.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(g.n_r * g.n_a - 1))))
    d = d.withColumns({"ir": F.floor(F.col("_cell") / g.n_a).cast("int"), "ia": (F.col("_cell") % g.n_a).cast("int")}).drop("_cell")
    return d.withColumns({"r": g.r_in + (F.col("ir") + 0.5) * F.lit(g.dr), "th": g.ang_1 + (F.col("ia") + 0.5) * F.lit(g.da)})


def cartesian(d: DataFrame) -> DataFrame:
    th = F.radians(F.col("th"))
    return d.withColumns({"x": F.col("r") * F.cos(th), "y": F.col("r") * F.sin(th)})


def corners(rows: DataFrame, g: Grid, r_ext: Column | None = None) -> DataFrame:
    """A row for each of the rows' (n_r + 1) x (n_a + 1) corners of cells, for any plotting client: ir, ia, r, th, x, y. r_ext replaces the grid's."""
    depth = (F.lit(g.r_ext) if r_ext is None else r_ext) - F.lit(g.r_in)
    d = rows.withColumn("_corner", F.explode(F.sequence(F.lit(0), F.lit((g.n_r + 1) * (g.n_a + 1) - 1))))
    d = d.withColumns({"ir": F.floor(F.col("_corner") / (g.n_a + 1)).cast("int"), "ia": (F.col("_corner") % (g.n_a + 1)).cast("int")}).drop("_corner")
    return cartesian(d.withColumns({"r": g.r_in + F.col("ir") * depth / g.n_r, "th": g.ang_1 + F.col("ia") * F.lit(g.da)}))


def magnitude(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def rows_of(values: Column, n_r: Column, n_a: Column) -> Column:
    """A flat row-major array as an array of rows."""
    return F.transform(F.sequence(F.lit(0), n_r - 1), lambda i: F.slice(values, i * n_a + 1, n_a))


def mirrored(values: Column, n_r: Column, n_a: Column) -> Column:
    """The flat array with each row reversed."""
    return F.flatten(F.transform(rows_of(values, n_r, n_a), lambda row: F.reverse(row)))


def to_cells(fields: DataFrame) -> DataFrame:
    """Array form to cell form: ir, ia, v instead of values."""
    d = fields.select(*[c for c in fields.columns if c != "values"], F.posexplode("values").alias("_at", "v"))
    return d.withColumns({"ir": F.floor(F.col("_at") / F.col("n_a")).cast("int"), "ia": (F.col("_at") % F.col("n_a")).cast("int")}).drop("_at")


def to_arrays(cells: DataFrame, keys: list[str], values: list[str], g: Grid) -> DataFrame:
    """Cell form to array form, row-major, an array for each of the values: no shuffle if the rows are dealt by a key, else one. A row's cells are sorted within its arrays."""
    at = F.struct((F.col("ir") * g.n_a + F.col("ia")).alias("at"), *values)
    d = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(at)).alias("_cells"))
    return d.select(*keys, F.lit(g.n_r).alias("n_r"), F.lit(g.n_a).alias("n_a"), *[F.col(f"_cells.{v}").alias(v) for v in values])
