"""The queries' SQL, written for DuckDB from the same definitions and none of the library's columns."""

from __future__ import annotations

from ..operators.grid import Grid
from ..operators.raster import sub_points

SEED = 42
#: The queries' grids: codes on the first, averages of POINTS points on the second, point samples on the third, the regions' shares, of POINTS points too, on the whole.
CODES, AVERAGES, SAMPLES, WHOLE, POINTS = Grid(n_r=8, n_a=24), Grid(n_r=4, n_a=12), Grid(n_r=20, n_a=60), Grid(), 64
N = 8  # rows and columns of the embeddings' grids
RANKS = {"m1": 3, "m2": 4}
#: Weights and biases of the queries' layers, and of the affine map beside the spectral layer.
LAYERS = [([[0.5, -0.25], [1.0, 0.75], [-0.5, 1.5]], [0.1, -0.2, 0.0]), ([[1.0, -1.0, 0.5], [0.25, 2.0, -0.75]], [0.0, 0.3])]
BYPASS = [([[0.5, -0.25], [1.5, 0.75]], [0.1, -0.2])]


def u(row_id: str, draw) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{SEED}', ({row_id})::VARCHAR, ({draw})::VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def tri(k: int, low: str, high: str, share: str) -> str:
    x, mode = u("design_id", k), f"(({low}) + {share}::DOUBLE * (({high}) - ({low})))"
    return (
        f"CASE WHEN {x} < ({mode} - ({low})) / (({high}) - ({low})) THEN ({low}) + sqrt({x} * (({high}) - ({low})) * ({mode} - ({low}))) "
        f"ELSE ({high}) - sqrt((1 - {x}) * (({high}) - ({low})) * (({high}) - {mode})) END"
    )


def arc(depth: str) -> str:
    return f"(2 * pi() * (stator_outer_diameter / 2 - {depth}) / 36)"


DESIGNS = f"""
d0 AS (SELECT p_partkey AS design_id, 42 AS number_rotor_poles, 36 AS number_stator_slots, 55.0::DOUBLE AS stator_inner_diameter, 90.0::DOUBLE AS rotor_outer_diameter, 0.0::DOUBLE AS slot_Rs FROM part),
d1 AS (SELECT *, {tri(1, "5.0::DOUBLE", "10.0::DOUBLE", "0.425")} AS stack_length, {tri(2, "68.0::DOUBLE", "81.0::DOUBLE", "0.8")} AS stator_outer_diameter, {tri(3, "0.5::DOUBLE", "2.0::DOUBLE", "0.3")} AS gap FROM d0),
d2 AS (SELECT *, stator_outer_diameter + 2 * gap AS rotor_inner_diameter, (stator_outer_diameter - 55.0::DOUBLE) / 2 AS depth FROM d1),
d3 AS (SELECT *, {tri(4, "1.5::DOUBLE", "(45.0::DOUBLE - rotor_inner_diameter / 2 - 1)", "0.8")} AS pole_thickness, {tri(5, "0.6::DOUBLE", "0.95::DOUBLE", "0.8")} AS pole_embrance,
  depth - ({tri(6, "(0.1::DOUBLE * depth)", "(0.3::DOUBLE * depth)", "0.5")}) AS h FROM d2),
d4 AS (SELECT *, 0.1::DOUBLE * h + (0.2::DOUBLE * h - 0.1::DOUBLE * h) * {u("design_id", 7)} AS slot_Hs0, 0.1::DOUBLE * h + (0.2::DOUBLE * h - 0.1::DOUBLE * h) * {u("design_id", 8)} AS slot_Hs1 FROM d3),
d5 AS (SELECT *, h - slot_Hs0 - slot_Hs1 AS slot_Hs2 FROM d4),
designs AS (SELECT *, {tri(9, "1.0::DOUBLE", f"(0.2::DOUBLE * {arc('0.0::DOUBLE')})", "0.3")} AS slot_Bs0,
  {tri(10, f"(0.3::DOUBLE * {arc('(slot_Hs0 + slot_Hs1)')})", f"(0.5::DOUBLE * {arc('(slot_Hs0 + slot_Hs1)')})", "0.5")} AS slot_Bs1,
  {tri(11, f"(0.4::DOUBLE * {arc('(slot_Hs0 + slot_Hs1 + slot_Hs2)')})", f"(0.65::DOUBLE * {arc('(slot_Hs0 + slot_Hs1 + slot_Hs2)')})", "0.5")} AS slot_Bs2 FROM d5)
"""
PARAMS = [
    "number_rotor_poles", "number_stator_slots", "stator_outer_diameter", "stator_inner_diameter", "stack_length", "slot_Hs0", "slot_Hs1", "slot_Hs2",
    "slot_Bs0", "slot_Bs1", "slot_Bs2", "slot_Rs", "rotor_outer_diameter", "rotor_inner_diameter", "pole_embrance", "pole_thickness",
]
ROUNDED = ", ".join(p if p.startswith("number") else f"round({p}, 9) + 0.0 AS {p}" for p in PARAMS)

PHASES = f"""
phases AS (SELECT d.*, p.phase_idx, (360.0::DOUBLE / 42) * {u("design_id", "100 + p.phase_idx")} AS phase_deg FROM designs d, (SELECT unnest(range(3))::INTEGER AS phase_idx) p),
radii AS (SELECT *, stator_inner_diameter / 2 AS r_si, stator_outer_diameter / 2 AS r_so, rotor_inner_diameter / 2 AS r_ri, rotor_outer_diameter / 2 AS r_ro, rotor_inner_diameter / 2 + pole_thickness AS r_pole,
  360.0::DOUBLE / 42 AS beta, 360.0::DOUBLE / 36 AS delta, stator_outer_diameter / 2 - slot_Hs0 AS r_open FROM phases),
shaped AS (SELECT *, r_open * cos(alpha / 2) AS chord FROM (SELECT *, acos((2 * r_open * r_open - slot_Bs0 * slot_Bs0) / (2 * r_open * r_open)) AS alpha FROM radii) x)
"""


def cells(g: Grid, of: str = "shaped") -> str:
    return f"""cells AS (SELECT s.*, c.ir, c.ia, {g.r_in}::DOUBLE + (c.ir + 0.5::DOUBLE) * {g.dr!r}::DOUBLE AS r, {g.ang_1}::DOUBLE + (c.ia + 0.5::DOUBLE) * {g.da!r}::DOUBLE AS th
  FROM {of} s, (SELECT (k // {g.n_a})::INTEGER AS ir, (k % {g.n_a})::INTEGER AS ia FROM (SELECT unnest(range({g.n_r * g.n_a})) AS k) y) c)"""


def flags(of: str, tag: str = "") -> str:
    """f0 to flagged: the regions at each row's r and th."""
    return f"""f0{tag} AS (SELECT *, radians(th - floor(th / delta + 0.5::DOUBLE) * delta) AS phi, th - phase_deg AS turned FROM {of}),
f1{tag} AS (SELECT *, r * cos(phi) AS sx, abs(r * sin(phi)) AS sy, floor(turned / beta) AS pole FROM f0{tag}),
f2{tag} AS (SELECT *, chord - sx AS deep, turned - pole * beta AS off FROM f1{tag}),
f3{tag} AS (SELECT *, deep >= 0 AND deep <= slot_Hs1 + slot_Hs2 AND sy <= CASE WHEN deep <= slot_Hs1 THEN slot_Bs0 / 2 + (slot_Bs1 - slot_Bs0) / 2 * (deep / slot_Hs1)
    ELSE slot_Bs1 / 2 + (slot_Bs2 - slot_Bs1) / 2 * ((deep - slot_Hs1) / slot_Hs2) END AS copper,
  r >= r_ri AND r <= r_pole AND off <= beta * pole_embrance AS magnet FROM f2{tag}),
flagged{tag} AS (SELECT *, r >= r_pole AND r <= r_ro AS back, magnet AND ((pole % 2) + 2) % 2 = 0 AS pole_p, magnet AND ((pole % 2) + 2) % 2 = 1 AS pole_n,
  r >= r_si AND r <= r_so AND NOT copper AND (abs(phi) > alpha / 2 OR sx <= chord) AS stator FROM f3{tag})"""


RASTER = f"WITH {DESIGNS}, {PHASES}, {cells(CODES)}, {flags('cells')}"
CODE = "CASE WHEN back OR stator THEN 6 WHEN pole_p THEN 1 WHEN pole_n THEN 5 WHEN copper THEN 3 ELSE 0 END"
MATERIALS = "(VALUES ('iron_1008', 6, 5000.0::DOUBLE, 0.0::DOUBLE), ('N35p', 1, 1.05::DOUBLE, 1.0::DOUBLE), ('N35n', 5, 1.05::DOUBLE, -1.0::DOUBLE), ('copper', 3, 0.999::DOUBLE, 0.0::DOUBLE), ('vacuum', 0, 1.0::DOUBLE, 0.0::DOUBLE)) m(material, code, mu, m)"
#: Number 0 is the centre, which gives the code alone.
POINT_VALUES = ", ".join(f"({n}, {s!r}::DOUBLE, {d!r}::DOUBLE)" for n, (s, d) in enumerate([(1.0, 0.0), *sub_points(AVERAGES, POINTS)]))
SHARES = f"""WITH {DESIGNS}, {PHASES}, {cells(AVERAGES)},
points AS (SELECT c.* REPLACE (c.r * p.s AS r, c.th + p.d AS th), p.n FROM cells c, (VALUES {POINT_VALUES}) p(n, s, d)), {flags('points')},
shares AS (SELECT design_id, phase_idx, ir, ia, first({CODE}) FILTER (n = 0) AS code, sum(((back OR stator) AND n > 0)::INT) / {POINTS}.0::DOUBLE AS f_iron, sum((pole_p AND n > 0)::INT) / {POINTS}.0::DOUBLE AS f_p, sum((pole_n AND n > 0)::INT) / {POINTS}.0::DOUBLE AS f_n, sum((copper AND n > 0)::INT) / {POINTS}.0::DOUBLE AS f_copper
  FROM (SELECT * FROM flagged) GROUP BY design_id, phase_idx, ir, ia)"""
MU = "round(5000.0::DOUBLE * f_iron + 1.05::DOUBLE * (f_p + f_n) + 0.999::DOUBLE * f_copper + greatest(1 - (f_iron + f_p + f_n + f_copper), 0.0::DOUBLE), 9)"

#: The refined averages' tolerance: three levels of parts.
TOLERANCE = 1 / 64
UPPER, LOWER = "((slot_Bs1 - slot_Bs0) / 2 / slot_Hs1)", "((slot_Bs2 - slot_Bs1) / 2 / slot_Hs2)"
OWN = "phi, turned, sx, sy, pole, deep, off, copper, magnet, back, pole_p, pole_n, stator"


def clear(rho: str) -> str:
    """No boundary within rho of a flagged row's point."""
    half = f"(CASE WHEN deep <= slot_Hs1 THEN slot_Bs0 / 2 + {UPPER} * deep ELSE slot_Bs1 / 2 + {LOWER} * (deep - slot_Hs1) END)"
    steep = f"({rho} * sqrt(1 + greatest({UPPER} * {UPPER}, {LOWER} * {LOWER})))"
    aside = "(r * (abs(phi) - alpha / 2))"
    radial = " AND ".join(f"abs(r - {x}) > {rho}" for x in ("r_si", "r_so", "r_ri", "r_pole", "r_ro"))
    return f"""({radial} AND (r < r_ri OR r > r_pole OR r * radians(least(off, abs(off - beta * pole_embrance), beta - off)) > {rho} * 1.05::DOUBLE)
      AND (r > r_so OR ((deep < -{rho} OR deep > slot_Hs1 + slot_Hs2 + {rho} OR sy - {half} > {steep} OR (deep > {rho} AND deep < slot_Hs1 + slot_Hs2 - {rho} AND {half} - sy > {steep}))
        AND (deep > {rho} OR {aside} > {rho} * 1.05::DOUBLE OR (deep < -{rho} AND {aside} < -1.05::DOUBLE * {rho})))))"""


def inside(side: str) -> dict[str, str]:
    """Shares of the regions in a square around a flagged row's point."""
    share = lambda *d: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + least({', '.join(d)}) / {side}))"
    ring, width = ["r - r_ri", "r_pole - r"], "(beta * pole_embrance)"
    own, after = share(*ring, f"r * radians(least(off, {width} - off))"), share(*ring, f"r * radians(greatest(off - beta, {width} - beta - off))")
    even = "((pole % 2) + 2) % 2 = 0"
    edge = f"CASE WHEN deep <= slot_Hs1 THEN (slot_Bs0 / 2 + {UPPER} * deep - sy) / sqrt(1 + {UPPER} * {UPPER}) ELSE (slot_Bs1 / 2 + {LOWER} * (deep - slot_Hs1) - sy) / sqrt(1 + {LOWER} * {LOWER}) END"
    copper = share("deep", "slot_Hs1 + slot_Hs2 - deep", edge)
    opening = share("r * (alpha / 2 - abs(phi))", "-deep", "r_so - r")
    iron = f"{share('r - r_pole', 'r_ro - r')} + greatest(0.0::DOUBLE, {share('r - r_si', 'r_so - r')} - {copper} - {opening})"
    return {"f_iron": iron, "f_p": f"CASE WHEN {even} THEN {own} ELSE {after} END", "f_n": f"CASE WHEN {even} THEN {after} ELSE {own} END", "f_copper": copper}


def fractions(g: Grid, k: int) -> str:
    """counted: how many of the k points of each cell's disk are in the regions, summed over the grid.

    Iron and copper don't turn, so a design's first phase has them; a cell that no boundary
    is near has its centre's flags k times. A point is in a pole if its radius is in the
    poles' ring and its angle in the pole, so there rings and angles are counted apart.
    """
    values = ", ".join(f"({n}, {s!r}::DOUBLE, {d!r}::DOUBLE)" for n, (s, d) in enumerate([(1.0, 0.0), *sub_points(g, k)]))
    odd = "((floor(turned / beta) % 2) + 2) % 2"
    return f"""WITH {DESIGNS}, {PHASES}, pts(n, s, d) AS (VALUES {values}), still AS (SELECT * FROM shaped WHERE phase_idx = 0), {cells(g, 'still')}, {flags('cells', '_c')},
chosen AS (SELECT * EXCLUDE ({OWN}), unnest(CASE WHEN {clear(f'(r * {g.disk!r}::DOUBLE)')} THEN [0] ELSE range(1, {k + 1}) END) AS n FROM flagged_c),
points AS (SELECT c.* EXCLUDE (n) REPLACE (c.r * p.s AS r, c.th + p.d AS th), CASE WHEN p.n = 0 THEN {k} ELSE 1 END AS w FROM chosen c JOIN pts p ON c.n = p.n), {flags('points')},
fixed AS (SELECT design_id, sum(w * (back OR stator)::INT) AS iron, sum(w * copper::INT) AS copper FROM flagged GROUP BY design_id),
rings AS (SELECT design_id, n, sum((r >= r_ri AND r <= r_pole)::INT) AS rings FROM (SELECT a.*, n, ({g.r_in}::DOUBLE + (ir + 0.5::DOUBLE) * {g.dr!r}::DOUBLE) * s AS r FROM still a, pts, range({g.n_r}) x(ir) WHERE n > 0) GROUP BY design_id, n),
angles AS (SELECT design_id, phase_idx, n, sum((inside AND {odd} = 0)::INT) AS p, sum((inside AND {odd} = 1)::INT) AS q FROM (SELECT *, turned - floor(turned / beta) * beta <= beta * pole_embrance AS inside
  FROM (SELECT design_id, phase_idx, beta, pole_embrance, n, {g.ang_1}::DOUBLE + (ia + 0.5::DOUBLE) * {g.da!r}::DOUBLE + d - phase_deg AS turned FROM shaped, pts, range({g.n_a}) x(ia) WHERE n > 0)) GROUP BY design_id, phase_idx, n),
poles AS (SELECT design_id, phase_idx, sum(p * rings) AS p, sum(q * rings) AS q FROM angles JOIN rings USING (design_id, n) GROUP BY design_id, phase_idx),
counted AS (SELECT design_id, phase_idx, iron, p, q, copper FROM poles JOIN fixed USING (design_id))"""


def refined(g: Grid, tolerance: float) -> str:
    """shares: of parts of disks that are split while a boundary may cross them."""
    disk, whole = f"{g.disk!r}::DOUBLE", {"f_iron": "(back OR stator)::INT", "f_p": "pole_p::INT", "f_n": "pole_n::INT", "f_copper": "copper::INT"}
    keys, level, size, sets = "design_id, phase_idx, ir, ia", 0, 1.0, []
    out = f"WITH {DESIGNS}, {PHASES}, {cells(g)}, {flags('cells', '_0')}, level_0 AS MATERIALIZED (SELECT * EXCLUDE ({OWN}), {CODE} AS code, r AS r0, th AS th0, 0 AS i, 0 AS j, NOT {clear(f'(r * {disk})')} AS open, {', '.join(f'{v} AS {k}' for k, v in whole.items())} FROM flagged_0)"
    while size > tolerance:
        sets.append(f"SELECT {keys}, code, {size!r}::DOUBLE AS share, {', '.join(whole)}, false AS open FROM level_{level} WHERE NOT open")
        level, size = level + 1, size / 4
        h = 0.5**level
        # the middle (a, b) of the part, its place in the disk and how far its corners are
        out += f""", split_{level} AS (SELECT l.* EXCLUDE (i, j, r, th, open, f_iron, f_p, f_n, f_copper), i * 2 + di AS i, j * 2 + dj AS j, (i * 2 + di) * 2 + 1 AS ia2, (j * 2 + dj) * 2 + 1 AS jb2 FROM level_{level - 1} l, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(di, dj) WHERE open),
        middle_{level} AS (SELECT * EXCLUDE (ia2, jb2), ia2 * {h!r}::DOUBLE - 1 AS a, jb2 * {h!r}::DOUBLE - 1 AS b FROM split_{level}),
        laid_{level} AS (SELECT * EXCLUDE (a, b), CASE WHEN abs(a) > abs(b) THEN a ELSE b END AS q, CASE WHEN abs(a) > abs(b) THEN b / a * (pi() / 4) ELSE pi() / 2 - a / b * (pi() / 4) END AS psi,
          {h!r}::DOUBLE * sqrt(1 + (pi() / 4) * (pi() / 4) * pow(1 + least(1.0::DOUBLE, (least(abs(a), abs(b)) + {h!r}::DOUBLE) / greatest(greatest(abs(a), abs(b)) - {h!r}::DOUBLE, 1e-9::DOUBLE)), 2)) AS reach FROM middle_{level}),
        placed_{level} AS (SELECT * EXCLUDE (q, psi), 1 + {disk} * q * cos(psi) AS px, {disk} * q * sin(psi) AS py FROM laid_{level}),
        points_{level} AS (SELECT * EXCLUDE (px, py), r0 * sqrt(px * px + py * py) AS r, th0 + degrees(atan2(py, px)) AS th FROM placed_{level}), {flags(f'points_{level}', f'_{level}')},
        told_{level} AS MATERIALIZED (SELECT *, NOT {clear(f'(r0 * {disk} * reach)')} AS open FROM flagged_{level}),
        level_{level} AS (SELECT * EXCLUDE ({OWN}, reach), {', '.join(f'{v} AS {k}' for k, v in whole.items())} FROM told_{level})"""
    side = f"(r0 * {disk} * sqrt(pi() * {size!r}::DOUBLE))"
    sets.append(f"SELECT {keys}, code, {size!r}::DOUBLE AS share, {', '.join(f'CASE WHEN open THEN {v} ELSE {whole[k]} END AS {k}' for k, v in inside(side).items())}, open FROM told_{level}")
    return f"{out}, parts AS ({' UNION ALL '.join(sets)}), shares AS (SELECT {keys}, first(code) AS code, {', '.join(f'sum(share * {k}) AS {k}' for k in whole)}, sum(share * open::INT) AS f_open, count(*)::BIGINT AS n_parts FROM parts GROUP BY {keys})"


FIELDS = f"""fields AS (SELECT vec_id // 12 AS design_id, ((vec_id // 4) % 3)::INTEGER AS phase_idx, ['Mu_avg', 'Magnetization', 'Mag_Bx', 'Mag_By'][(vec_id % 4)::INTEGER + 1] AS field, embedding::DOUBLE[] AS v, label FROM embeddings),
gridcells AS (SELECT design_id, phase_idx, field, (k // {N})::INTEGER AS ir, (k % {N})::INTEGER AS ia, v[k + 1] AS v, label FROM (SELECT *, unnest(range({N * N})) AS k FROM fields) z)"""
EXPECTED = "expected AS (SELECT design_id, phase_idx, field FROM (SELECT DISTINCT design_id FROM fields) a, (SELECT unnest(range(3))::INTEGER AS phase_idx) b, (SELECT unnest(['Mu_avg', 'Magnetization', 'Mag_Bx', 'Mag_By']) AS field) c), present AS (SELECT * FROM fields WHERE label <> 9)"
TENSOR = f"""WITH {FIELDS}
SELECT design_id * 3 + phase_idx AS sample_ix, CASE WHEN field IN ('Mu_avg', 'Magnetization') THEN 'x' ELSE 'y' END AS tensor,
  CASE WHEN field IN ('Mu_avg', 'Mag_Bx') THEN 0 ELSE 1 END AS ch, ir, ia, v::FLOAT::DOUBLE AS v FROM gridcells"""
MODES = f"modes AS (SELECT a.k::INTEGER AS kx, b.k::INTEGER AS ky FROM (SELECT unnest(range({N})) AS k) a, (SELECT unnest(range({N // 2 + 1})) AS k) b)"
TURN = f"(2 * pi() * ((kx * ir * {N} + ky * ia * {N}) % {N * N}) / {N * N})"
CHANNELS = f"channels AS (SELECT design_id * 3 + phase_idx AS sample_ix, CASE WHEN field IN ('Mu_avg') THEN 0 WHEN field = 'Magnetization' THEN 1 WHEN field = 'Mag_Bx' THEN 2 ELSE 3 END AS ch, ir, ia, v FROM gridcells)"
SPECTRA = f"""WITH {FIELDS}, {CHANNELS}, {MODES},
spectra AS (SELECT sample_ix, ch, kx, ky, sum(v * cos({TURN})) AS re, -sum(v * sin({TURN})) AS im FROM channels, modes GROUP BY ALL)"""
LOW = f"low AS (SELECT *, CASE WHEN kx >= {N - RANKS['m1']} THEN 2 ELSE 1 END AS block FROM spectra WHERE ky < {RANKS['m2']} AND (kx < {RANKS['m1']} OR kx >= {N - RANKS['m1']}))"
_M1, _M2 = RANKS["m1"], RANKS["m2"]
WEIGHTS = f"""weights AS (SELECT *, {u("'0-' || id", 1)} AS wr, {u("'0-' || id", 2)} AS wi FROM (
  SELECT id, (id % {_M2})::INTEGER AS ky, (id // {_M2} % {_M1})::INTEGER AS wx, (id // {_M2 * _M1} % 2)::INTEGER AS ch_out, (id // {_M2 * _M1 * 2} % 2)::INTEGER AS ch_in, (id // {_M2 * _M1 * 4})::INTEGER + 1 AS block
  FROM (SELECT unnest(range({2 * 4 * _M1 * _M2})) AS id) q) w)"""
MIXED = f"""mixed AS (SELECT l.sample_ix, w.ch_out AS ch, l.kx, l.ky, sum(l.re * w.wr - l.im * w.wi) AS re, sum(l.re * w.wi + l.im * w.wr) AS im
  FROM (SELECT *, CASE WHEN block = 2 THEN kx - {N - _M1} ELSE kx END AS wx FROM low WHERE ch < 2) l JOIN weights w ON w.block = l.block AND w.ch_in = l.ch AND w.wx = l.wx AND w.ky = l.ky GROUP BY ALL)"""
PLACES = f"places AS (SELECT a.k::INTEGER AS ir, b.k::INTEGER AS ia FROM (SELECT unnest(range({N})) AS k) a, (SELECT unnest(range({N})) AS k) b)"


PAIRS = "pairs AS (SELECT sample_ix, ir, ia, max(v) FILTER (ch = 0) AS x0, max(v) FILTER (ch = 1) AS x1 FROM channels GROUP BY ALL)"


def affine(w: list[float], b: float, of: str = "x") -> str:
    return "(" + " + ".join(f"{x!r}::DOUBLE * {of}{k}" for k, x in enumerate(w)) + f" + {b!r}::DOUBLE)"


def gelu(x: str) -> str:
    """By the error function's series; beyond 5 it is 1 to 12 places."""
    z = f"greatest(-5.0::DOUBLE, least(5.0::DOUBLE, {x} / sqrt(2.0::DOUBLE)))"
    return f"0.5::DOUBLE * {x} * (1 + 2 / sqrt(pi()) * list_sum(list_transform(range(0, 110), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * pow({z}, 2 * k + 1) / (gamma(k + 1.0::DOUBLE) * (2 * k + 1)))))"


def back(of: str, places: int = 6) -> str:
    return f"SELECT sample_ix, ch, ir, ia, round(sum(CASE WHEN ky = 0 OR ky * 2 = {N} THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END * (re * cos({TURN}) - im * sin({TURN}))) / {N * N}, {places}) + 0.0 AS v FROM {of}, places GROUP BY ALL"


#: What two runs leave: the first lacks grids of label 9 and spoils those of 8, the second lacks those of 9 of even designs, and takes up what the first left incomplete.
RUNS = f"""WITH {FIELDS}, one AS (SELECT design_id, count(*) FILTER (label NOT IN (8, 9))::INTEGER AS n FROM fields GROUP BY design_id),
two AS (SELECT design_id, count(*) FILTER (label <> 9 OR design_id % 2 = 1)::INTEGER AS n FROM fields GROUP BY design_id),
ends AS (SELECT design_id, CASE WHEN one.n = 12 THEN 1 ELSE 2 END AS run, CASE WHEN one.n = 12 THEN 12 ELSE two.n END AS n_present FROM one JOIN two USING (design_id))"""
def permuted(epoch: int) -> str:
    """The place of sample_ix among n, round after round; keys are reduced to n in SQL, as the table tells it."""
    import hashlib

    keys = []
    for r in range(32):
        x = hashlib.md5(f"{SEED}:{epoch}:{r}".encode()).digest()
        keys.append([int.from_bytes(x[i : i + 5], "big") for i in (0, 5, 10)])
    p = 2**31 - 1
    rounds = "[" + ", ".join(f"{{'k': {k}::BIGINT, 'a': {1 + a % (p - 1)}::BIGINT, 'b': {b % p}::BIGINT, 'x': 0::BIGINT}}" for k, a, b in keys) + "]"
    y = "(((r.k % n) - s.x + n) % n)"
    step = f"CASE WHEN (greatest(s.x, {y}) % {p} * r.a + r.b) % {p} < {p // 2} THEN {y} ELSE s.x END"
    return f"list_reduce({rounds}, lambda s, r: {{'k': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT, 'x': {step}}}, {{'k': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT, 'x': sample_ix}}).x"


def solved(n: int) -> str:
    """s0 to sn: the normal equations of channels 0 to n - 1 to channel n, and what is left of them after each channel is told."""
    sums = [f"sum(z{j}.re * z{i}.re + z{j}.im * z{i}.im) {'+ 1e-6::DOUBLE' if i == j else ''} AS r{i}{j}, sum(z{j}.im * z{i}.re - z{j}.re * z{i}.im) AS i{i}{j}" for i in range(n) for j in range(n + 1)]
    joins = " ".join(f"JOIN spectra z{k} ON z{k}.ch = {k} AND z{k}.sample_ix = z0.sample_ix AND z{k}.kx = z0.kx AND z{k}.ky = z0.ky" for k in range(1, n + 1))
    out = f"s0 AS (SELECT z0.kx, z0.ky, count(*)::BIGINT AS n, {', '.join(sums)} FROM spectra z0 {joins} WHERE z0.ch = 0 GROUP BY ALL)"
    for p in range(n):
        size = f"(r{p}{p} * r{p}{p} + i{p}{p} * i{p}{p})"
        part = ", ".join(f"(r{p}{j} * r{p}{p} + i{p}{j} * i{p}{p}) / {size} AS pr{j}, (i{p}{j} * r{p}{p} - r{p}{j} * i{p}{p}) / {size} AS pi{j}" for j in range(n + 1))
        rest = ", ".join(f"pr{j} AS r{i}{j}, pi{j} AS i{i}{j}" if i == p else f"r{i}{j} - (r{i}{p} * pr{j} - i{i}{p} * pi{j}) AS r{i}{j}, i{i}{j} - (r{i}{p} * pi{j} + i{i}{p} * pr{j}) AS i{i}{j}" for i in range(n) for j in range(n + 1))
        out += f", p{p} AS (SELECT *, {part} FROM s{p}), s{p + 1} AS (SELECT kx, ky, n, {rest} FROM p{p})"
    return out


R6 = "round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im"
LINES = "lines AS (SELECT l_orderkey * 8 + l_linenumber AS sample_ix, l_extendedprice::DOUBLE AS y, l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE) AS out FROM lineitem)"
BATCHES = f"batched AS (SELECT *, (row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', '0', sample_ix::VARCHAR)), sample_ix) - 1) // 32 AS batch_id FROM lines)"
NAME = r"([A-Za-z_]+?)_(\d+)_p(\d+)\.csv"


def oracle_sql() -> dict[str, str]:
    g, s = CODES, SAMPLES
    return {
        "uniform_draw": f"SELECT p_partkey AS design_id, draw::INTEGER AS draw, {u('p_partkey', 'draw')} AS u FROM part, (SELECT unnest(range(1, 12)) AS draw) d",
        "triangular_draw": f"SELECT design_id, {tri(1, '5.0::DOUBLE', '10.0::DOUBLE', '0.425')} AS v FROM (SELECT p_partkey AS design_id FROM part) d",
        "design_sample": f"WITH {DESIGNS} SELECT design_id, {ROUNDED} FROM designs",
        "phase_draw": f"WITH {DESIGNS}, {PHASES} SELECT design_id, phase_idx, round(phase_deg, 9) + 0.0 AS phase_deg FROM phases",
        "slot_opening_angle": f"WITH {DESIGNS}, {PHASES} SELECT DISTINCT design_id, round(degrees(alpha), 6) + 0.0 AS opening_deg, round(chord, 6) + 0.0 AS chord FROM shaped",
        "design_lookup": f"WITH {DESIGNS} SELECT l_orderkey, l_linenumber, design_id, round(stator_outer_diameter, 9) + 0.0 AS stator_outer_diameter, round(pole_thickness, 9) + 0.0 AS pole_thickness FROM lineitem JOIN designs ON l_partkey = design_id",
        "polar_grid": f"WITH {DESIGNS}, {PHASES}, {cells(AVERAGES, 'designs')} SELECT design_id, ir, ia, round(r, 9) + 0.0 AS r, round(th, 9) + 0.0 AS th FROM cells",
        "polar_xy": f"WITH {DESIGNS}, {cells(AVERAGES, 'designs')} SELECT design_id, ir, ia, round(r * cos(radians(th)), 6) + 0.0 AS x, round(r * sin(radians(th)), 6) + 0.0 AS y FROM cells",
        "grid_corners": f"""WITH {DESIGNS} SELECT design_id, ir, ia, round(r * cos(radians(th)), 6) + 0.0 AS x, round(r * sin(radians(th)), 6) + 0.0 AS y FROM (
          SELECT design_id, (k // 5)::INTEGER AS ir, (k % 5)::INTEGER AS ia, 27.5::DOUBLE + (k // 5) * (stator_outer_diameter / 2 - 27.5::DOUBLE) / 2 AS r, (k % 5) * 30.0::DOUBLE AS th FROM designs, (SELECT unnest(range(15)) AS k) c) q""",
        "back_iron_mask": f"{RASTER} SELECT design_id, phase_idx, sum(back::INT)::BIGINT AS n FROM flagged GROUP BY ALL",
        "pole_sector": f"{RASTER} SELECT design_id, phase_idx, sum(pole_p::INT)::BIGINT AS n_p, sum(pole_n::INT)::BIGINT AS n_n FROM flagged GROUP BY ALL",
        "coil_mask": f"{RASTER} SELECT design_id, phase_idx, sum(copper::INT)::BIGINT AS n FROM flagged GROUP BY ALL",
        "stator_mask": f"{RASTER} SELECT design_id, phase_idx, sum(stator::INT)::BIGINT AS n FROM flagged GROUP BY ALL",
        "material_grid": f"{RASTER} SELECT design_id, phase_idx, {CODE} AS code, count(*)::BIGINT AS n FROM flagged GROUP BY ALL",
        "air_gap_mask": f"{RASTER} SELECT design_id, phase_idx, sum((r BETWEEN 0.9::DOUBLE * r_si AND 1.1::DOUBLE * r_ro AND NOT (back OR stator OR pole_p OR pole_n OR copper))::INT)::BIGINT AS n FROM flagged GROUP BY ALL",
        "material_arrays": f"{RASTER} SELECT design_id, phase_idx, string_agg(({CODE})::VARCHAR, ',' ORDER BY ir, ia) AS codes FROM flagged GROUP BY ALL",
        "material_property_join": f"{RASTER} SELECT material, m.code, count(*)::BIGINT AS n, round(sum(mu), 3) + 0.0 AS mu, round(sum(m), 3) + 0.0 AS m FROM (SELECT {CODE} AS code FROM flagged) f JOIN {MATERIALS} ON f.code = m.code GROUP BY ALL",
        "mu_avg_grid": f"{SHARES} SELECT design_id, phase_idx, ir, ia, {MU} + 0.0 AS mu_avg FROM shares",
        "sample_arrays": f"{SHARES} SELECT design_id, phase_idx, string_agg(code::VARCHAR, ',' ORDER BY ir, ia) AS codes, count(*)::INTEGER AS n, sum(({MU})::DECIMAL(20, 9))::DOUBLE AS mu_avg, sum((f_p - f_n)::DECIMAL(20, 9))::DOUBLE + 0.0 AS magnetization FROM shares GROUP BY ALL",
        "refined_averages": f"{refined(AVERAGES, TOLERANCE)} SELECT design_id, phase_idx, ir, ia, code, n_parts, f_open, {MU.replace(', 9)', ', 6)')} + 0.0 AS mu_avg, round(f_p - f_n, 6) + 0.0 AS magnetization FROM shares",
        "magnetization_grid": f"{SHARES} SELECT design_id, phase_idx, ir, ia, f_p - f_n + 0.0 AS magnetization FROM shares",
        "area_fractions": f"{fractions(WHOLE, POINTS)} SELECT design_id, phase_idx, {', '.join(f'{a} / {POINTS}.0::DOUBLE AS f_{b}' for a, b in (('iron', 'iron'), ('p', 'p'), ('q', 'n'), ('copper', 'copper')))} FROM counted",
        "field_resample": f"""WITH p AS (SELECT 27.5::DOUBLE + (l_partkey % 1750) / 100.0::DOUBLE AS r, (l_orderkey % 12000) / 100.0::DOUBLE AS th, l_quantity::DOUBLE AS bx, l_discount::DOUBLE AS b_y FROM lineitem)
          SELECT floor((r - 27.5::DOUBLE) / {s.dr!r}::DOUBLE)::INTEGER AS ir, floor(th / {s.da!r}::DOUBLE)::INTEGER AS ia, count(*)::BIGINT AS n, round(avg(bx), 6) + 0.0 AS bx, round(avg(b_y), 6) + 0.0 AS b_y FROM p WHERE r < 45.0 AND th < 120.0 GROUP BY ALL""",
        "field_filled": f"""WITH p AS (SELECT c_custkey, c_nationkey, 27.5::DOUBLE + (c_custkey * 37 % 1750) / 100.0::DOUBLE AS r, (c_custkey * 7919 % 12000) / 100.0::DOUBLE AS th, c_acctbal::DOUBLE AS v FROM customer),
          b AS (SELECT *, floor((r - 27.5::DOUBLE) / {s.dr!r}::DOUBLE)::INTEGER AS ir, floor(th / {s.da!r}::DOUBLE)::INTEGER AS ia FROM p),
          m AS (SELECT c_nationkey, ir, ia, count(*)::BIGINT AS n, avg(v) AS v FROM b GROUP BY ALL),
          c AS (SELECT n.c_nationkey, (k // {s.n_a})::INTEGER AS ir, (k % {s.n_a})::INTEGER AS ia, 27.5::DOUBLE + (k // {s.n_a} + 0.5::DOUBLE) * {s.dr!r}::DOUBLE AS cr, (k % {s.n_a} + 0.5::DOUBLE) * {s.da!r}::DOUBLE AS ct FROM (SELECT DISTINCT c_nationkey FROM b) n, (SELECT unnest(range({s.n_r * s.n_a})) AS k) y),
          e AS (SELECT c.* FROM c LEFT JOIN m USING (c_nationkey, ir, ia) WHERE m.n IS NULL),
          d AS (SELECT e.c_nationkey, e.ir, e.ia, round(b.r * b.r + cr * cr - 2 * b.r * cr * cos(radians(b.th - ct)), 9) AS d2, c_custkey, v FROM e JOIN b ON e.c_nationkey = b.c_nationkey),
          t AS (SELECT c_nationkey, ir, ia, min((d2, c_custkey, v)) AS x FROM d GROUP BY ALL)
          SELECT c_nationkey, ir, ia, n, NULL::BIGINT AS from_id, 0.0::DOUBLE AS distance, round(v, 6) + 0.0 AS v FROM m
          UNION ALL SELECT c_nationkey, ir, ia, 0, x[2], round(sqrt(greatest(x[1], 0.0::DOUBLE)), 6) + 0.0, round(x[3], 6) + 0.0 FROM t""",
        "design_csv_roundtrip": f"WITH {DESIGNS} SELECT design_id, {ROUNDED} FROM designs",
        "matrix_csv_roundtrip": f"WITH {FIELDS} SELECT design_id, phase_idx, field, ir, ia, v FROM gridcells",
        "field_parquet_roundtrip": f"WITH {FIELDS} SELECT design_id, phase_idx, field, ir, ia, v FROM gridcells",
        "tensor_roundtrip": TENSOR,
        "file_listing": f"WITH {FIELDS} SELECT field, design_id, phase_idx FROM fields",
        "key_parse": f"""WITH n AS (SELECT ['Mag_Bx', 'Mag_By', 'Magnetization', 'Material', 'Mu_avg'][(l_linenumber % 5)::INTEGER + 1] || '_' || l_orderkey || '_p' || l_linenumber || '.csv' AS name FROM lineitem)
          SELECT name, regexp_extract(name, '^{NAME}$', 1) AS field, regexp_extract(name, '^{NAME}$', 2)::BIGINT AS design_id, regexp_extract(name, '^{NAME}$', 3)::INTEGER AS phase_idx FROM n""",
        "grid_quarantine": """WITH t AS (SELECT 'e' || event_id AS id, props AS s FROM events UNION ALL SELECT 'v' || vec_id, array_to_string(embedding::DOUBLE[], ',') FROM embeddings),
          p AS (SELECT id, string_split(s, ',') AS x FROM t WHERE s IS NOT NULL AND trim(s) <> '')
          SELECT CASE WHEN len(list_filter(x, lambda v: TRY_CAST(trim(v) AS DOUBLE) IS NULL)) > 0 THEN 'not a number' WHEN len(list_filter(x, lambda v: NOT isfinite(TRY_CAST(trim(v) AS DOUBLE)))) > 0 THEN 'not finite' ELSE 'good' END AS reason, count(*)::BIGINT AS n FROM p GROUP BY ALL
          UNION ALL SELECT 'empty', count(*)::BIGINT FROM t WHERE s IS NULL OR trim(s) = '' HAVING count(*) > 0""",
        "quarantine_tables": f"""WITH g AS (SELECT vec_id AS id, vec_id % 20 AS k, embedding::DOUBLE[] AS v FROM embeddings),
          t AS (SELECT id, 'grid' AS field, CASE WHEN k = 9 THEN id - 1 WHEN k <> 10 THEN id END AS design_id, CASE WHEN k = 1 THEN 'NaN,' || array_to_string(v[2:8], ',') WHEN k = 2 THEN array_to_string(v[1:7], ',') || ',-Infinity' WHEN k = 3 THEN array_to_string(v[1:8], ',')
            WHEN k = 4 THEN array_to_string(v[1:8], ',') || chr(10) || array_to_string(v[9:15], ',') WHEN k = 5 THEN ' ' || chr(10) WHEN k = 6 THEN array_to_string(v, ',') || ',x'
            ELSE array_to_string(list_transform(range({N}), lambda i: array_to_string(v[i * {N} + 1:i * {N} + {N}], ',')), chr(10)) END AS s FROM g
            UNION ALL SELECT -1 - event_id, 'event', event_id::BIGINT, props FROM events),
          p AS (SELECT *, list_transform(list_filter(string_split(coalesce(s, ''), chr(10)), lambda x: trim(x) <> ''), lambda x: string_split(x, ',')) AS rows FROM t),
          q AS (SELECT *, flatten(rows) AS c, len(rows) AS n_r, coalesce(len(rows[1]), 0) AS n_a FROM p),
          r AS (SELECT *, CASE WHEN design_id IS NULL THEN 'no key' WHEN n_r = 0 THEN 'empty' WHEN len(list_filter(rows, lambda x: len(x) <> n_a)) > 0 THEN 'ragged' WHEN len(list_filter(c, lambda x: TRY_CAST(trim(x) AS DOUBLE) IS NULL)) > 0 THEN 'not a number'
            WHEN len(list_filter(c, lambda x: NOT isfinite(TRY_CAST(trim(x) AS DOUBLE)))) > 0 THEN 'not finite' WHEN n_r <> {N} OR n_a <> {N} THEN 'wrong size' END AS reason FROM q),
          w AS (SELECT *, CASE WHEN reason IS NULL AND count(*) FILTER (reason IS NULL) OVER (PARTITION BY field, design_id) > 1 THEN 'duplicate key' ELSE coalesce(reason, 'good') END AS told FROM r)
          SELECT field, design_id, told AS reason, CASE WHEN told = 'good' THEN {N * N} ELSE 0 END::INTEGER AS n FROM w""",
        "run_ledger": f"{RUNS} SELECT design_id, run, run AS attempts, n_present, CASE WHEN n_present = 12 THEN 'ok' ELSE 'failed' END AS state FROM ends",
        "run_fields": f"{RUNS} SELECT c.design_id, phase_idx, field, ir, ia, v FROM gridcells c JOIN ends e ON c.design_id = e.design_id WHERE e.n_present = 12",
        "explode_grid": f"WITH {FIELDS} SELECT design_id, phase_idx, field, ir, ia, v FROM gridcells",
        "missing_designs": f"WITH {FIELDS}, {EXPECTED} SELECT DISTINCT design_id FROM (SELECT * FROM expected EXCEPT SELECT design_id, phase_idx, field FROM present) x",
        "coverage_report": f"WITH {FIELDS}, {EXPECTED} SELECT e.design_id, count(*)::BIGINT AS n_expected, count(p.field)::BIGINT AS n_present, count(DISTINCT CASE WHEN p.field IS NOT NULL THEN e.phase_idx END)::BIGINT AS n_phases FROM expected e LEFT JOIN present p USING (design_id, phase_idx, field) GROUP BY ALL",
        "expected_except_present": f"WITH {FIELDS}, {EXPECTED} SELECT * FROM expected EXCEPT SELECT design_id, phase_idx, field FROM present",
        "mirror_augment": f"WITH {FIELDS} SELECT design_id, phase_idx, field, ir, ia, v FROM gridcells UNION ALL SELECT design_id, phase_idx + 3, field, ir, {N - 1} - ia, v FROM gridcells",
        "mirror_sink": f"WITH {FIELDS} SELECT design_id, phase_idx + 3 AS phase_idx, field, ir, {N - 1} - ia AS ia, v FROM gridcells",
        "assemble_tensor": TENSOR,
        "dataset_shape": f"WITH {FIELDS} SELECT count(DISTINCT design_id * 3 + phase_idx)::BIGINT AS n, 2 AS c_x, 2 AS c_y, {N} AS n_r, {N} AS n_a FROM fields",
        "resume_worklist": f"WITH {FIELDS}, {EXPECTED}, {DESIGNS} SELECT design_id, {ROUNDED} FROM designs WHERE design_id IN (SELECT design_id FROM (SELECT * FROM expected EXCEPT SELECT design_id, phase_idx, field FROM present) x)",
        "run_summary": f"WITH {FIELDS}, {EXPECTED}, c AS (SELECT e.design_id, count(*) AS n, count(p.field) AS k FROM expected e LEFT JOIN present p USING (design_id, phase_idx, field) GROUP BY ALL) SELECT CASE WHEN k = n THEN 'ok' WHEN k = 0 THEN 'failed' ELSE 'pending' END AS state, count(*)::BIGINT AS n_designs, sum(n - k)::BIGINT AS n_missing FROM c GROUP BY ALL",
        "sample_ordinal": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS sample_ix FROM orders",
        "split_train_test": "WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS sample_ix FROM orders) SELECT o_orderkey, sample_ix, CASE WHEN sample_ix < floor((SELECT count(*) FROM s) * 0.75::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM s",
        "bucketed_pairs": f"WITH {FIELDS}, p AS (SELECT x.design_id * 3 + x.phase_idx AS sample_ix, x.v::FLOAT::DOUBLE - y.v::FLOAT::DOUBLE AS e FROM gridcells x JOIN gridcells y USING (design_id, phase_idx, ir, ia) WHERE (x.field, y.field) IN (('Mu_avg', 'Mag_Bx'), ('Magnetization', 'Mag_By'))) SELECT sample_ix, count(*)::INTEGER AS n, round(avg(e * e), 6) AS mse FROM p GROUP BY ALL",
        "epoch_batches": f"WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS sample_ix, (SELECT count(*) FROM orders) AS n FROM orders) SELECT o_orderkey, sample_ix, {', '.join(f'({permuted(e)}) // 32 AS batch_{e}' for e in (0, 1))} FROM s",
        "minibatches": f"WITH {LINES}, {BATCHES} SELECT sample_ix, batch_id FROM batched",
        "mse": f"WITH {LINES} SELECT count(*)::BIGINT AS n, round(avg((out - y) * (out - y)), 2) AS mse FROM lines",
        "epoch_loss": f"WITH {LINES}, {BATCHES} SELECT count(*)::BIGINT AS n_batches, round(avg(loss), 2) AS epoch_loss FROM (SELECT avg((out - y) * (out - y)) AS loss FROM batched GROUP BY batch_id) b",
        "field_order": f"WITH {FIELDS} SELECT design_id, phase_idx, field, row_number() OVER (ORDER BY design_id, phase_idx, field) - 1 AS position FROM fields",
        "param_count": f"SELECT DISTINCT {N} AS n_r, {N} AS n_a, ((2 * 64 + 64) + (64 * 64 + 64) + (64 * 3 + 3) + 4 * (2 * 3 * 3 * least(80, {N}) * least(240, {N // 2 + 1}) + 3 * 3 + 3) + (3 * 64 + 64) + (64 * 64 + 64) + (64 * 2 + 2))::BIGINT AS n_params FROM embeddings",
        "head_sample_magnitude": f"WITH {FIELDS} SELECT x.ir, x.ia, round(sqrt(x.v * x.v + y.v * y.v), 9) + 0.0 AS b FROM gridcells x JOIN gridcells y USING (design_id, phase_idx, ir, ia) WHERE x.field = 'Mag_Bx' AND y.field = 'Mag_By' AND design_id = 0 AND phase_idx = 0",
        "field_magnitude": f"WITH {FIELDS} SELECT design_id, phase_idx, x.ir, x.ia, round(sqrt(x.v * x.v + y.v * y.v), 9) + 0.0 AS b FROM gridcells x JOIN gridcells y USING (design_id, phase_idx, ir, ia) WHERE x.field = 'Mag_Bx' AND y.field = 'Mag_By'",
        "rfft2": f"{SPECTRA} SELECT sample_ix, ch, kx, ky, {R6} FROM spectra",
        "rfft2_batches": f"{SPECTRA} SELECT sample_ix, ch, kx, ky, {R6} FROM spectra WHERE ch < 2",
        "mode_truncate": f"{SPECTRA}, {LOW} SELECT sample_ix, ch, kx, ky, block, {R6} FROM low",
        "spectral_mix": f"{SPECTRA}, {LOW}, {WEIGHTS}, {MIXED} SELECT sample_ix, ch, kx, ky, {R6} FROM mixed",
        "irfft2_batches": f"{SPECTRA}, {PLACES}, low AS (SELECT * FROM spectra WHERE ch < 2) {back('low')}",
        "rfft2_rows": f"{SPECTRA} SELECT sample_ix, ch, kx, ky, {R6} FROM spectra WHERE ch < 2",
        "irfft2_rows": f"{SPECTRA}, {LOW}, {WEIGHTS}, {MIXED}, {PLACES} {back('mixed')}",
        "spectral_conv_batches": f"{SPECTRA}, {LOW}, {WEIGHTS}, {MIXED}, {PLACES} {back('mixed')}",
        "channel_layers": f"WITH {FIELDS}, {CHANNELS}, {PAIRS}, h AS (SELECT *, {', '.join(f'{gelu(affine(w, b))} AS h{k}' for k, (w, b) in enumerate(zip(*LAYERS[0])))} FROM pairs), o AS (SELECT sample_ix, ir, ia, unnest([{', '.join(affine(w, b, 'h') for w, b in zip(*LAYERS[1]))}]) AS v, unnest([0, 1]) AS ch FROM h) SELECT sample_ix, ch, ir, ia, round(v, 6) + 0.0 AS v FROM o",
        "residual_block": f"{SPECTRA}, {LOW}, {WEIGHTS}, {MIXED}, {PLACES}, {PAIRS}, conv AS ({back('mixed', 15)}), beside AS (SELECT sample_ix, ir, ia, unnest([{', '.join(affine(w, b) for w, b in zip(*BYPASS[0]))}]) AS u, unnest([0, 1]) AS ch FROM pairs) SELECT sample_ix, ch, ir, ia, round({gelu('(v + u)')}, 6) + 0.0 AS v FROM conv JOIN beside USING (sample_ix, ch, ir, ia)",
        "gelu": f"WITH {FIELDS}, {CHANNELS} SELECT sample_ix, ch, ir, ia, v, round({gelu('v')}, 6) + 0.0 AS g FROM channels",
        "irfft2": f"{SPECTRA}, {PLACES} {back('spectra')}",
        "spectral_conv": f"{SPECTRA}, {LOW}, {WEIGHTS}, {MIXED}, {PLACES} {back('mixed')}",
        "pointwise_mix": f"WITH {FIELDS}, {CHANNELS} SELECT sample_ix, o.ch, ir, ia, round(sum(v * w) + o.b, 6) + 0.0 AS v FROM channels c JOIN (VALUES (0, 0, 0.5::DOUBLE), (1, 0, -0.25::DOUBLE), (2, 0, 1.0::DOUBLE), (3, 0, 2.0::DOUBLE), (0, 1, 1.5::DOUBLE), (1, 1, 0.75::DOUBLE), (2, 1, -1.0::DOUBLE), (3, 1, 0.125::DOUBLE)) w(ci, co, w) ON c.ch = w.ci JOIN (VALUES (0, 0.1::DOUBLE), (1, -0.2::DOUBLE)) o(ch, b) ON o.ch = w.co GROUP BY sample_ix, o.ch, ir, ia, o.b",
        "spectral_fit_two": f"""{SPECTRA}, s AS (SELECT a.kx, a.ky, count(*)::BIGINT AS n, sum(a.re * a.re + a.im * a.im) + 1e-6::DOUBLE AS aa, sum(b.re * b.re + b.im * b.im) + 1e-6::DOUBLE AS bb, sum(b.re * a.re + b.im * a.im) AS pr, sum(b.im * a.re - b.re * a.im) AS pi,
            sum(y.re * a.re + y.im * a.im) AS ur, sum(y.im * a.re - y.re * a.im) AS ui, sum(y.re * b.re + y.im * b.im) AS vr, sum(y.im * b.re - y.re * b.im) AS vi
            FROM spectra a JOIN spectra b USING (sample_ix, kx, ky) JOIN spectra y USING (sample_ix, kx, ky) WHERE a.ch = 0 AND b.ch = 1 AND y.ch = 2 GROUP BY ALL), t AS (SELECT *, aa * bb - pr * pr - pi * pi AS det FROM s)
          SELECT kx, ky, n, round((bb * ur - pr * vr + pi * vi) / det, 6) + 0.0 AS w1r, round((bb * ui - pr * vi - pi * vr) / det, 6) + 0.0 AS w1i, round((aa * vr - pr * ur - pi * ui) / det, 6) + 0.0 AS w2r, round((aa * vi - pr * ui + pi * ur) / det, 6) + 0.0 AS w2i FROM t""",
        "spectral_fit_many": f"{SPECTRA}, {solved(3)} " + " UNION ALL ".join(f"SELECT kx, ky, n, {k} AS ch, round(r{k}3, 6) + 0.0 AS wr, round(i{k}3, 6) + 0.0 AS wi FROM s3" for k in range(3)),
        "spectral_fit": f"{SPECTRA}, s AS (SELECT x.kx, x.ky, count(*)::BIGINT AS n, sum(x.re * x.re + x.im * x.im) AS xx, sum(y.re * x.re + y.im * x.im) AS re, sum(y.im * x.re - y.re * x.im) AS im FROM spectra x JOIN spectra y USING (sample_ix, kx, ky) WHERE x.ch = 0 AND y.ch = 2 GROUP BY ALL) SELECT kx, ky, n, round(re / (xx + 1e-6::DOUBLE), 6) + 0.0 AS wr, round(im / (xx + 1e-6::DOUBLE), 6) + 0.0 AS wi FROM s",
        "stream_versions": f"""WITH {FIELDS}, e AS (SELECT vec_id // 12 AS design_id, vec_id % 12 AS grid, label, unnest(CASE WHEN label <> 9 THEN [(vec_id, true)] WHEN vec_id % 2 = 0 THEN [(vec_id, true), (vec_id + 30, false)] ELSE [(vec_id, true), (vec_id + 30, false), (vec_id + 45, true)] END) AS x FROM embeddings),
          g AS (SELECT design_id, grid, max_by(x[2], x[1]) AS there, max(x[1]) AS last FROM e GROUP BY ALL)
          SELECT design_id, sum(there::INT)::INTEGER AS n_present, sum(there::INT) >= 12 AS complete, max(last) + 120 < (SELECT max(last) FROM g) - 60 AS closed FROM g GROUP BY design_id""",
        "stream_completeness": f"WITH {FIELDS}, {EXPECTED} SELECT design_id, count(*)::BIGINT AS n_present, count(*) >= 12 AS complete FROM present GROUP BY ALL",
    }


