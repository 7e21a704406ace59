"""Shares of the regions in cells' disks over numpy arrays, for Arrow batches of designs and phases.

The predicates are those of `regions`, in the same order of operations. A grid's points
are the same for all designs, so what depends on them alone is computed once a batch.
"""

from __future__ import annotations

import math

import numpy as np

from .regions import MATERIALS

#: The columns of `regions.with_radii` that the shares need.
COLUMNS = ["phase_deg", "r_si", "r_so", "r_ri", "r_ro", "r_pole", "pole_pitch", "slot_pitch", "opening_rad", "chord", "pole_embrance", "slot_Bs0", "slot_Bs1", "slot_Bs2", "slot_Hs1", "slot_Hs2"]
#: Elements of one array at a time.
BLOCK = 2**17
#: Parts of a row's last level up to which all are computed.
WHOLE = 2**13


def codes(iron, pole_p, pole_n, copper):
    """The first material in order of precedence that covers the point, else vacuum."""
    number = {m: c for m, c, _, _ in MATERIALS}
    return np.where(iron, number["iron_1008"], np.where(pole_p, number["N35p"], np.where(pole_n, number["N35n"], np.where(copper, number["copper"], number["vacuum"])))).astype("int32")


def _coil(c, x, y):
    deep = c["chord"] - x
    upper = c["slot_Bs0"] / 2 + (c["slot_Bs1"] - c["slot_Bs0"]) / 2 * (deep / c["slot_Hs1"])
    lower = c["slot_Bs1"] / 2 + (c["slot_Bs2"] - c["slot_Bs1"]) / 2 * ((deep - c["slot_Hs1"]) / c["slot_Hs2"])
    return (deep >= 0) & (deep <= c["slot_Hs1"] + c["slot_Hs2"]) & (np.abs(y) <= np.where(deep <= c["slot_Hs1"], upper, lower))


def _odd(number):
    half = number * 0.5
    return np.floor(half) != half


def _designs(c: dict) -> tuple[dict, np.ndarray]:
    """(COLUMNS of the rows' designs, each row's design): neighbouring rows that differ in their phase alone are one."""
    still = np.stack([c[x] for x in COLUMNS[1:]])
    first = np.r_[True, (still[:, 1:] != still[:, :-1]).any(axis=0)]
    own = {x: c[x][first] for x in COLUMNS}
    wide, bottom = np.maximum(np.maximum(own["slot_Bs0"], own["slot_Bs1"]), own["slot_Bs2"]) / 2, own["slot_Hs1"] + own["slot_Hs2"]
    own["slots_reach"] = np.maximum(own["r_so"], np.hypot(np.maximum(own["chord"], bottom - own["chord"]), wide) * (1 + 1e-9))  # of teeth, yokes and coils
    return own, np.cumsum(first) - 1


def _period(angles, pitch: float) -> int:
    """The number of angles after which their places in a slot pitch come again; all of them, if they don't."""
    n = len(angles)
    steps = pitch / (angles[1] - angles[0]) if n > 1 else 0.0
    return round(steps) if 0.5 < steps < n and abs(steps - round(steps)) < 1e-9 else n


def _still_counts(own: dict, rings, angles, s, d) -> tuple[dict, np.ndarray]:
    """How many of the points are in iron and copper, designs x rings x places, and each angle's place.

    These don't turn, so they come again with the slots where the angles do. All points of
    a cell that no boundary is near have its centre's flags; the others' are computed.
    """
    m, k, period = len(own["r_si"]), len(s), _period(angles, own["slot_pitch"][0])
    out = {f: np.zeros(m * len(rings) * period, "int32") for f in ("iron", "copper")}
    reach = np.hypot(s * np.cos(np.radians(d)) - 1, s * np.sin(np.radians(d))).max() * (1 + 1e-9)
    pitch = own["slot_pitch"][0]
    th = angles[:period, None] + d
    phi = np.radians(th - np.floor(th / pitch + 0.5) * pitch)
    cos, sin, aside = np.cos(phi), np.sin(phi), np.abs(phi)
    each = len(rings) * period
    for lo in range(0, m * each, BLOCK):
        at = np.arange(lo, min(lo + BLOCK, m * each))
        ring, angle = at % each // period, at % period
        iron, copper, clear = _Points(own, at // each, rings[ring], angles[angle]).still(rings[ring] * reach)
        out["iron"][at], out["copper"][at] = iron * k, copper * k
        near = at[~clear]
        for a in range(0, len(near), max(1, BLOCK // k)):
            at = near[a : a + max(1, BLOCK // k)]
            p, ring, angle = {x: own[x][at // each, None] for x in COLUMNS}, at % each // period, at % period
            r = rings[ring][:, None] * s
            x, y = r * cos[angle], r * sin[angle]
            coil = _coil(p, x, y)
            iron = (r >= p["r_si"]) & (r <= p["r_so"]) & ~coil & ((aside[angle] > p["opening_rad"] / 2) | (x <= p["chord"])) | (r >= p["r_pole"]) & (r <= p["r_ro"])
            out["iron"][at], out["copper"][at] = iron.sum(axis=1), coil.sum(axis=1)
    return {f: v.reshape(m, len(rings), period) for f, v in out.items()}, np.arange(len(angles)) % period


def _poles(c: dict, rings, angles, s, d):
    """Parts of the rows, with which points are in a pole of either kind by their angle, rows x angles x points, and in the poles' ring by their radius, rows x rings x points."""
    r, th = rings[:, None] * s, angles[:, None] + d
    rows = max(1, BLOCK // th.size)
    for a in range(0, len(c["phase_deg"]), rows):
        part = {x: c[x][a : a + rows, None, None] for x in COLUMNS}
        turned = th - part["phase_deg"]
        number = np.floor(turned / part["pole_pitch"])
        inside, odd = turned - number * part["pole_pitch"] <= part["pole_pitch"] * part["pole_embrance"], _odd(number)
        yield slice(a, a + rows), {"pole_p": inside & ~odd, "pole_n": inside & odd}, (r >= part["r_ri"]) & (r <= part["r_pole"])


def counts(c: dict, rings, angles, s, d) -> dict:
    """How many of the points (ring times s, angle plus d) are in each region, rows x rings x angles. c: COLUMNS, an array of the rows each, of one slot pitch.

    Iron and copper don't turn, so neighbouring rows that differ in their phase alone share
    them. Whether a point is in the poles' ring depends on its radius, and whether it is in
    a pole's angle on its angle, so the points that are in both are a matrix product.
    """
    own, of = _designs(c)
    out = {f: np.zeros((len(of), len(rings), len(angles)), "int32") for f in ("pole_p", "pole_n")}
    step = max(1, BLOCK // len(s))
    for lo in range(0, len(angles), step):
        for rows, poles, ring in _poles(c, rings, angles[lo : lo + step], s, d):
            ring = ring.astype("float32").transpose(0, 2, 1)
            for f, on in poles.items():
                out[f][rows, :, lo : lo + step] = (on.astype("float32") @ ring).transpose(0, 2, 1)
    fixed, again = _still_counts(own, rings, angles, s, d)
    return {**{f: v[:, :, again][of] for f, v in fixed.items()}, **out}


def totals(c: dict, rings, angles, s, d) -> dict:
    """The sums of counts over all rings and angles, an integer a row."""
    own, of = _designs(c)
    out, step = {f: np.zeros(len(of), "int64") for f in ("pole_p", "pole_n")}, max(1, BLOCK // len(s))
    for lo in range(0, len(angles), step):
        for rows, poles, ring in _poles(c, rings, angles[lo : lo + step], s, d):
            for f, on in poles.items():
                out[f][rows] += (on.sum(axis=1) * ring.sum(axis=1)).sum(axis=1)
    fixed, again = _still_counts(own, rings, angles, s, d)
    return {**{f: (v.sum(axis=1, dtype="int64") @ np.bincount(again))[of] for f, v in fixed.items()}, **out}


# ------------------------------------------------------------------ refined


def parts(level: int) -> dict:
    """The parts of a level, by i 2^level + j, in a disk of radius 1: q and psi, the place of their middles, and reach, how far their corners are from these at most.

    Parts are squares of the square [-1, 1] x [-1, 1], which is laid on the disk: the
    larger coordinate is the distance from the disk's centre, and the other's share of it
    the angle from the axis.
    """
    h = 0.5**level
    middle = (np.arange(2**level) * 2 + 1) * h - 1
    a, b = (x.ravel() for x in np.meshgrid(middle, middle, indexing="ij"))
    wide, most = np.abs(a) > np.abs(b), np.maximum(np.abs(a), np.abs(b))
    steep = np.minimum(1.0, (np.minimum(np.abs(a), np.abs(b)) + h) / np.maximum(most - h, 1e-9))
    if level == 0:
        return {"q": np.zeros(1), "psi": np.zeros(1), "reach": np.ones(1)}
    return {"q": np.where(wide, a, b), "psi": np.where(wide, b / a * (math.pi / 4), math.pi / 2 - a / b * (math.pi / 4)), "reach": h * np.sqrt(1 + (math.pi / 4) ** 2 * (1 + steep) * (1 + steep))}


class _Points:
    """Points (r, th) of rows: the predicates, distances and shares there. Columns are picked as they are asked for."""

    def __init__(self, c: dict, row, r, th):
        self.c, self.row, self.r, self.th = c, row, r, th

    def __getitem__(self, name):
        return self.c[name][self.row]

    def at(self, where):
        return _Points(self.c, self.row[where], self.r[where], self.th[where])

    def turn(self):
        """Number of the pole, angle from its edge, pitch and the pole's width."""
        pitch = self["pole_pitch"]
        turned = self.th - self["phase_deg"]
        number = np.floor(turned / pitch)
        return number, turned - number * pitch, pitch, pitch * self["pole_embrance"]

    def frame(self):
        """phi, x, y in the frame of the nearest slot."""
        pitch = self["slot_pitch"]
        phi = np.radians(self.th - np.floor(self.th / pitch + 0.5) * pitch)
        return phi, self.r * np.cos(phi), self.r * np.sin(phi)

    def sides(self, x):
        """deep, bottom, the coil's half width there, and the slopes of its sides."""
        b0, b1, b2, h1, h2 = (self[k] for k in ("slot_Bs0", "slot_Bs1", "slot_Bs2", "slot_Hs1", "slot_Hs2"))
        deep, upper, lower = self["chord"] - x, (b1 - b0) / 2 / h1, (b2 - b1) / 2 / h2
        return deep, h1 + h2, np.where(deep <= h1, b0 / 2 + upper * deep, b1 / 2 + lower * (deep - h1)), upper, lower, deep <= h1

    def still(self, rho):
        """(iron, copper, clear), of what doesn't turn; see told."""
        r = self.r
        pole, ro, so, si = (self[k] for k in ("r_pole", "r_ro", "r_so", "r_si"))
        clear = np.abs(r - si) > rho
        for edge in (so, pole, ro):
            clear &= np.abs(r - edge) > rho
        iron, copper = (r >= pole) & (r <= ro), np.zeros(len(r), bool)
        slots = np.flatnonzero(r <= self["slots_reach"])
        if len(slots):
            own = self.at(slots)
            phi, x, y = own.frame()
            copper[slots] = coil = _coil(own, x, y)
            deep, opening, so, rho = own["chord"] - x, own["opening_rad"] / 2, so[slots], rho[slots]
            iron[slots] |= (own.r >= si[slots]) & (own.r <= so) & ~coil & ((np.abs(phi) > opening) | (x <= own["chord"]))
            deep, bottom, half, upper, lower, _ = own.sides(x)
            y, steep = np.abs(y), rho * np.sqrt(1 + np.maximum(upper * upper, lower * lower))
            coils = (deep < -rho) | (deep > bottom + rho) | (y - half > steep) | ((deep > rho) & (deep < bottom - rho) & (half - y > steep))
            aside = own.r * (np.abs(phi) - opening)
            clear[slots] &= (own.r > so) | coils & ((deep > rho) | (aside > rho * 1.05) | ((deep < -rho) & (aside < rho * -1.05)))
        return iron, copper, clear

    def told(self, rho):
        """(iron, pole_p, pole_n, copper, clear): clear if no region's boundary is within rho (mm), so that the flags hold in a disk of that radius. Never true wrongly; false a little beyond rho.

        Lines at an angle are held off by 1.05 rho along the arc, slanted sides of coils by
        their steepness. Poles are computed in their ring alone, and slots where they reach.
        """
        r = self.r
        iron, copper, clear = self.still(rho)
        ri, pole = self["r_ri"], self["r_pole"]
        clear &= np.abs(r - ri) > rho
        p, n = np.zeros(len(r), bool), np.zeros(len(r), bool)
        ring = np.flatnonzero((r >= ri) & (r <= pole))
        if len(ring):
            own = self.at(ring)
            number, offset, pitch, width = own.turn()
            odd, inside = _odd(number), offset <= width
            p[ring], n[ring] = inside & ~odd, inside & odd
            nearest = np.minimum(np.minimum(offset, np.abs(offset - width)), pitch - offset)
            clear[ring] &= own.r * np.radians(nearest) > rho[ring] * 1.05
        return iron, p, n, copper, clear

    def inside(self, side):
        """The share of each region in a small square of the given side (mm) around the point, by the distance to the nearest edge; right to first order near a single edge."""
        r = self.r
        number, offset, pitch, width = self.turn()
        ring = [r - self["r_ri"], self["r_pole"] - r]
        own, after = _share(side, *ring, r * np.radians(np.minimum(offset, width - offset))), _share(side, *ring, r * np.radians(np.maximum(offset - pitch, width - pitch - offset)))
        odd = _odd(number)
        iron, copper = self.inside_still(side)
        return iron, np.where(odd, after, own), np.where(odd, own, after), copper

    def inside_still(self, side):
        """The shares of iron and copper, which don't turn."""
        r = self.r
        phi, x, y = self.frame()
        deep, bottom, half, upper, lower, high = self.sides(x)
        copper = _share(side, deep, bottom - deep, (half - np.abs(y)) / np.sqrt(1 + np.where(high, upper * upper, lower * lower)))
        opening = _share(side, r * (self["opening_rad"] / 2 - np.abs(phi)), -deep, self["r_so"] - r)
        stator = np.maximum(0.0, _share(side, r - self["r_si"], self["r_so"] - r) - copper - opening)
        return _share(side, r - self["r_pole"], self["r_ro"] - r) + stator, copper


def _share(side, *distances):
    """The share of a small square that is within edges at these distances of its middle."""
    least = distances[0]
    for x in distances[1:]:
        least = np.minimum(least, x)
    return np.maximum(0.0, np.minimum(1.0, 0.5 + least / side))


def _laid(level: int, rings, disk: float):
    """Of a level's parts: radius and reach (mm), rings x parts, and the degrees from their cell's angle."""
    k = parts(level)
    x, y = 1 + disk * k["q"] * np.cos(k["psi"]), disk * k["q"] * np.sin(k["psi"])
    return rings[:, None] * np.sqrt(x * x + y * y), rings[:, None] * disk * k["reach"], np.degrees(np.arctan2(y, x))


def _last_level(tolerance: float) -> int:
    level, size = 1, 0.25
    while size > tolerance:
        level, size = level + 1, size / 4
    return level


def _count(flags):
    """How many of the last axis are true."""
    if flags.shape[-1] % 8:
        return flags.sum(axis=-1)
    return np.bitwise_count(np.ascontiguousarray(flags).view("uint64")).sum(axis=-1, dtype="int64")  # eight flags a word


def _refined_whole(c: dict, rings, angles, disk: float, last: int) -> dict:
    """refined for few parts: those of all levels are computed, whether they were split or not, which spares picking them.

    Then a level's radii are the same for all angles, and what depends on the poles'
    angles alone for all rings; what doesn't turn is made once a design, and once a slot
    pitch where the angles come again with it.
    """
    own, of = _designs(c)
    n, m, n_r, n_a = len(of), len(own["r_si"]), len(rings), len(angles)
    period = _period(angles, own["slot_pitch"][0])
    again, half = np.arange(n_a) % period, 0.5**last
    side = (rings * (disk * math.sqrt(math.pi * half * half)))[:, None, None]
    names = ("f_iron", "f_p", "f_n", "f_copper")
    out = {f: np.zeros((n, n_r, n_a)) for f in (*names, "f_open")} | {"n_parts": np.zeros((n, n_r, n_a), "int64"), "code": np.zeros((n, n_r, n_a), "int32")}
    levels = []
    for level in range(last + 1):
        r, rho, turn = _laid(level, rings, disk)
        shape = (m, n_r, period, len(turn))
        flat = lambda x: np.broadcast_to(x, shape).ravel()  # noqa: B023, E731
        points = _Points(own, flat(np.arange(m)[:, None, None, None]), flat(r[:, None]), flat(angles[:period, None] + turn))
        iron, copper, clear = points.still(flat(rho[:, None]))
        shares = [x.reshape(shape) for x in points.inside_still(flat(side))] if level == last else None
        i, j = np.divmod(np.arange(len(turn)), 2**level)
        levels.append((r[:, None], rho[:, None] * 1.05, rho[:, None], angles[:, None] + turn, [x.reshape(shape) for x in (iron, copper, clear)], shares, (i >> 1 << max(0, level - 1)) + (j >> 1)))
    rows = max(1, BLOCK // (n_r * n_a * 4**last))
    for lo in range(0, n, rows):
        at, design = slice(lo, lo + rows), of[lo : lo + rows]
        part = {x: c[x][at, None, None] for x in ("phase_deg", "pole_pitch", "pole_embrance", "r_ri", "r_pole")}
        ri, pole = (part[x][..., None] for x in ("r_ri", "r_pole"))
        whole = None
        for level, (r, wide, rho, th, still, inside, parent) in enumerate(levels):
            iron, copper, clear = (x[design][:, :, again] for x in still)
            turned, pitch, width = th - part["phase_deg"], part["pole_pitch"], part["pole_pitch"] * part["pole_embrance"]
            number = np.floor(turned / pitch)
            offset, odd = turned - number * pitch, _odd(number)[:, None]
            on = (offset <= width)[:, None]
            ring = (r >= ri) & (r <= pole)
            p = ring & (on & ~odd)
            q = ring & (on & odd)
            nearest = np.radians(np.minimum(np.minimum(offset, np.abs(offset - width)), pitch - offset))[:, None]
            off = (np.abs(r - ri) > rho) & (np.abs(r - pole) > rho) & (~ring | (r * nearest > wide))  # from edges of poles
            clear &= off
            if level == 0:
                out["code"][at] = codes(iron, p, q, copper)[..., 0]
                whole = np.ones(clear.shape, bool)
            else:
                whole = whole.take(parent, axis=3)
            done, size = whole & clear, 0.25**level
            whole &= ~clear
            for f, flag in zip(names, (iron, p, q, copper)):
                out[f][at] += _count(done & flag) * size
            out["n_parts"][at] += _count(done)
        left, open_parts = _count(whole), whole.astype(float)
        out["n_parts"][at] += left
        out["f_open"][at] += left * size
        for f, v in zip(("f_iron", "f_copper"), inside):
            out[f][at] += np.einsum("nrap,nrap->nra", open_parts, v[design][:, :, again]) * size
        # off poles' edges a part is in one or not; by the others the nearest edge tells how much is
        for f, flag in (("f_p", p), ("f_n", q)):
            out[f][at] += _count(whole & off & flag) * size
        row, i, j, k = np.nonzero(whole & ~off)
        x = {name: v[row, 0, 0] for name, v in part.items() if name in ("pole_pitch", "r_ri", "r_pole")}
        r, offset, width, edge = levels[-1][0][i, 0, k], offset[row, j, k], width[row, 0, 0], side[i, 0, 0]
        odd, between = odd[row, 0, j, k], np.minimum(r - x["r_ri"], x["r_pole"] - r)
        first, after = _share(edge, between, r * np.radians(np.minimum(offset, width - offset))), _share(edge, between, r * np.radians(np.maximum(offset - x["pole_pitch"], width - x["pole_pitch"] - offset)))
        cell = (row * n_r + i) * n_a + j
        for f, v in (("f_p", np.where(odd, after, first)), ("f_n", np.where(odd, first, after))):
            out[f][at] += np.bincount(cell, v, left.size).reshape(left.shape) * size
    return {f: v.reshape(n, -1) for f, v in out.items()}


def refined(c: dict, rings, angles, disk: float, tolerance: float) -> dict:
    """code, the four regions' shares, f_open and n_parts of each cell, rows x cells, by a quadtree of its disk; see raster.refined_fractions. c: COLUMNS, an array of the rows each."""
    last = _last_level(tolerance)
    if len(rings) * len(angles) * 4**last <= WHOLE:
        return _refined_whole(c, rings, angles, disk, last)
    own, of = _designs(c)
    c = {**c, "slots_reach": own["slots_reach"][of]}
    n, cells = len(c["phase_deg"]), len(rings) * len(angles)
    ring, angle = np.repeat(rings, len(angles)), np.tile(angles, len(rings))
    out = {f: np.zeros(n * cells) for f in ("f_iron", "f_p", "f_n", "f_copper", "f_open")}
    out["n_parts"], size = np.zeros(n * cells, "int64"), 1.0
    at, part, level = np.arange(n * cells), np.zeros(n * cells, "int64"), 0
    while len(at):
        k = parts(level)
        x, y = 1 + disk * k["q"] * np.cos(k["psi"]), disk * k["q"] * np.sin(k["psi"])
        row, cell = at // cells, at % cells
        r0 = ring[cell]
        points = _Points(c, row, r0 * np.sqrt(x * x + y * y)[part], angle[cell] + np.degrees(np.arctan2(y, x))[part])
        *flags, clear = points.told(r0 * disk * k["reach"][part])
        if level == 0:
            out["code"] = codes(*flags)
        done = np.ones(len(at), bool) if level == last else clear
        values = [f.astype(float) for f in flags]
        if level == last and not clear.all():
            still = np.flatnonzero(~clear)
            for v, s in zip(values, points.at(still).inside(r0[still] * (disk * math.sqrt(math.pi * size)))):
                v[still] = s
            out["f_open"] += np.bincount(at[still], minlength=n * cells) * size
        for f, v in zip(("f_iron", "f_p", "f_n", "f_copper"), values):
            out[f] += np.bincount(at[done], v[done], minlength=n * cells) * size
        out["n_parts"] += np.bincount(at[done], minlength=n * cells)
        i, j, at = part[~done] >> level, part[~done] & (2**level - 1), np.repeat(at[~done], 4)
        level, size = level + 1, size / 4
        part = ((np.repeat(i, 4) * 2 + np.tile([0, 0, 1, 1], len(i))) << level) + np.repeat(j, 4) * 2 + np.tile([0, 1, 0, 1], len(i))
    return {k: v.reshape(n, cells) for k, v in out.items()}
