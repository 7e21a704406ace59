"""Which material is at a point: predicates on polar coordinates and a design's columns.

A region is a Boolean column, so a caller can add one; all inequalities are closed.
Columns expected: r, th (degrees), phase_deg, and the columns of `with_radii`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code, permeability and magnetisation of each material, in order of precedence.
MATERIALS = [("iron_1008", 6, 5000.0, 0.0), ("N35p", 1, 1.05, 1.0), ("N35n", 5, 1.05, -1.0), ("copper", 3, 0.999, 0.0), ("vacuum", 0, 1.0, 0.0)]


def with_radii(designs: DataFrame) -> DataFrame:
    """Adds, once a design, what the predicates need: radii, pitches, the slot opening's angle and the chord at it."""
    opening = F.col("stator_outer_diameter") / 2 - F.col("slot_Hs0")
    d = designs.withColumns(
        {
            "r_si": F.col("stator_inner_diameter") / 2,
            "r_so": F.col("stator_outer_diameter") / 2,
            "r_ri": F.col("rotor_inner_diameter") / 2,
            "r_ro": F.col("rotor_outer_diameter") / 2,
            "pole_pitch": F.lit(360.0) / F.col("number_rotor_poles"),
            "slot_pitch": F.lit(360.0) / F.col("number_stator_slots"),
            "opening_rad": slot_opening_angle(opening, F.col("slot_Bs0")),
        }
    )
    return d.withColumns({"r_pole": F.col("r_ri") + F.col("pole_thickness"), "chord": opening * F.cos(F.col("opening_rad") / 2)})


def slot_opening_angle(radius: Column, width: Column) -> Column:
    """The angle that a chord of the given width spans at the radius."""
    return F.acos((2 * radius * radius - width * width) / (2 * radius * radius))


def slot_frame(r: Column, th: Column) -> tuple[Column, Column, Column]:
    """(angle, x, y) of the point in the frame of the nearest slot."""
    phi = F.radians(th - F.floor(th / F.col("slot_pitch") + 0.5) * F.col("slot_pitch"))
    return phi, r * F.cos(phi), r * F.sin(phi)


def back_iron(r: Column) -> Column:
    return (r >= F.col("r_pole")) & (r <= F.col("r_ro"))


def pole(r: Column, th: Column, parity: int) -> Column:
    turned = th - F.col("phase_deg")
    number = F.floor(turned / F.col("pole_pitch"))
    offset = turned - number * F.col("pole_pitch")
    return (r >= F.col("r_ri")) & (r <= F.col("r_pole")) & (offset <= F.col("pole_pitch") * F.col("pole_embrance")) & (F.pmod(number, F.lit(2)) == parity)


def coil(x: Column, y: Column) -> Column:
    """A hexagon: half widths Bs0/2, Bs1/2 and Bs2/2 at depths 0, Hs1 and Hs1 + Hs2 under the chord."""
    deep = F.col("chord") - x
    upper = F.col("slot_Bs0") / 2 + (F.col("slot_Bs1") - F.col("slot_Bs0")) / 2 * (deep / F.col("slot_Hs1"))
    lower = F.col("slot_Bs1") / 2 + (F.col("slot_Bs2") - F.col("slot_Bs1")) / 2 * ((deep - F.col("slot_Hs1")) / F.col("slot_Hs2"))
    half = F.when(deep <= F.col("slot_Hs1"), upper).otherwise(lower)
    return (deep >= 0) & (deep <= F.col("slot_Hs1") + F.col("slot_Hs2")) & (F.abs(y) <= half)


def stator(r: Column, phi: Column, x: Column, in_coil: Column) -> Column:
    """Teeth and yoke; in a slot's opening only what is under the chord."""
    return (r >= F.col("r_si")) & (r <= F.col("r_so")) & ~in_coil & ((F.abs(phi) > F.col("opening_rad") / 2) | (x <= F.col("chord")))


def with_flags(points: DataFrame, r: str = "r", th: str = "th") -> DataFrame:
    """Adds iron, pole_p, pole_n, copper, and the frame's phi, sx, sy."""
    phi, x, y = slot_frame(F.col(r), F.col(th))
    p = points.withColumns({"phi": phi, "sx": x, "sy": y})
    p = p.withColumns({"copper": coil(F.col("sx"), F.col("sy")), "pole_p": pole(F.col(r), F.col(th), 0), "pole_n": pole(F.col(r), F.col(th), 1)})
    return p.withColumn("iron", back_iron(F.col(r)) | stator(F.col(r), F.col("phi"), F.col("sx"), F.col("copper")))


def code() -> Column:
    """The first material in order of precedence that covers the point, else vacuum."""
    flags = {"iron_1008": "iron", "N35p": "pole_p", "N35n": "pole_n", "copper": "copper"}
    return F.coalesce(*[F.when(F.col(flags[m]), F.lit(c)) for m, c, _, _ in MATERIALS if m in flags], F.lit(0))
