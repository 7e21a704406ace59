"""Sampling of designs and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import triangular, uniform, uniform01

#: Fixed values of the design space.
POLES, SLOTS, STATOR_INNER, ROTOR_OUTER = 42, 36, 55.0, 90.0
#: Fixed: the parameters in order, with their units.
UNITS = {
    "number_rotor_poles": None, "number_stator_slots": None, "stator_outer_diameter": "mm", "stator_inner_diameter": "mm", "stack_length": "mm", "slot_Hs0": "mm", "slot_Hs1": "mm", "slot_Hs2": "mm",
    "slot_Bs0": "mm", "slot_Bs1": "mm", "slot_Bs2": "mm", "slot_Rs": "mm", "rotor_outer_diameter": "mm", "rotor_inner_diameter": "mm", "pole_embrance": None, "pole_thickness": "mm",
}
PHASE_DRAW = 100


def header(name: str) -> str:
    return f"{name} [{UNITS[name]}]" if UNITS[name] else name


def sample_designs(ids: DataFrame, seed: int = 42, id_col: str = "design_id") -> DataFrame:
    """A design for each id: eleven draws, whose bounds depend on the values before. Units are in the columns' metadata."""
    u = lambda k: uniform01(seed, F.col(id_col), k)
    c = F.col

    def tri(k: int, low, high, mode_share: float) -> Column:
        low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
        return triangular(u(k), low, high, low + mode_share * (high - low))

    d = ids.select(F.col(id_col)).withColumns({"number_rotor_poles": F.lit(POLES), "number_stator_slots": F.lit(SLOTS), "stator_inner_diameter": F.lit(STATOR_INNER), "rotor_outer_diameter": F.lit(ROTOR_OUTER), "slot_Rs": F.lit(0.0)})
    d = d.withColumns({"stack_length": tri(1, 5, 10, 0.425), "stator_outer_diameter": tri(2, (STATOR_INNER + ROTOR_OUTER - 9) / 2, ROTOR_OUTER - 9, 0.8), "gap": tri(3, 0.5, 2, 0.3)})
    d = d.withColumn("rotor_inner_diameter", c("stator_outer_diameter") + 2 * c("gap"))
    d = d.withColumns({"pole_thickness": tri(4, 1.5, ROTOR_OUTER / 2 - c("rotor_inner_diameter") / 2 - 1, 0.8), "pole_embrance": tri(5, 0.6, 0.95, 0.8), "depth": (c("stator_outer_diameter") - STATOR_INNER) / 2})
    d = d.withColumn("h", c("depth") - tri(6, 0.1 * c("depth"), 0.3 * c("depth"), 0.5))
    d = d.withColumns({"slot_Hs0": uniform(u(7), 0.1 * c("h"), 0.2 * c("h")), "slot_Hs1": uniform(u(8), 0.1 * c("h"), 0.2 * c("h"))})
    d = d.withColumn("slot_Hs2", c("h") - c("slot_Hs0") - c("slot_Hs1"))
    arc = lambda depth: 2 * F.pi() * (c("stator_outer_diameter") / 2 - depth) / SLOTS
    top, mid, low = arc(F.lit(0.0)), arc(c("slot_Hs0") + c("slot_Hs1")), arc(c("slot_Hs0") + c("slot_Hs1") + c("slot_Hs2"))
    d = d.withColumns({"slot_Bs0": tri(9, 1, 0.2 * top, 0.3), "slot_Bs1": tri(10, 0.3 * mid, 0.5 * mid, 0.5), "slot_Bs2": tri(11, 0.4 * low, 0.65 * low, 0.5)})
    return d.select(id_col, *[F.col(x).alias(x, metadata={"unit": unit}) if unit else F.col(x) for x, unit in UNITS.items()])


def dealt(designs: DataFrame, parts: int | None = None, id_col: str = "design_id") -> DataFrame:
    """Designs dealt to tasks by id, so that nothing by design, phase or cell is shuffled after; draws are made once, before.

    parts defaults to spark.sql.shuffle.partitions; few rows are not put together, as each becomes many cells.
    """
    return designs.repartition(parts or int(designs.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)


def sample_phases(designs: DataFrame, n_phases: int = 3, seed: int = 42) -> DataFrame:
    """designs with phase_idx and phase_deg, uniform over one pole pitch; n_phases rows a design, without a shuffle."""
    d = designs.withColumn("phase_idx", F.explode(F.sequence(F.lit(0), F.lit(n_phases - 1))))
    return d.withColumn("phase_deg", uniform(uniform01(seed, F.col("design_id"), F.lit(PHASE_DRAW) + F.col("phase_idx")), F.lit(0.0), F.lit(360.0) / F.col("number_rotor_poles")))


SCHEMA = T.StructType([T.StructField("design_id", T.LongType()), *[T.StructField(x, T.IntegerType() if x.startswith("number") else T.DoubleType()) for x in UNITS]])
