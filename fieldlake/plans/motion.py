"""Queries of interpolation, trajectories, generators, sources and runs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldlake.functions import kernels as K
from fieldlake.functions.grid import Grid
from fieldlake.model import POINT
from fieldlake.operators import dynamics as W
from fieldlake.operators import generate as G
from fieldlake.operators import particles as P
from fieldlake.operators import spectral as S
from fieldlake.operators import stats as A
from fieldlake.operators import transform as T
from fieldlake.plans import jobs
from fieldlake.plans import views as V
from fieldlake.plans.spectra import cube, line, r, rounded
from fieldlake.sources import io
from fieldlake.sources.shared import new_path

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_H = "(2 * pi() / 64)"
query("p1_cells", f"WITH {V.PTS} SELECT particle, CAST((floor(x / {_H}) % 64 + 64) % 64 AS INTEGER) AS cx, {r(f'x / {_H} - floor(x / {_H})', 'ox')} FROM pts")(lambda s, d: rounded(P.locate(V.pts(s, d), Grid(64)), ["particle", "cx"], ["ox"]))


def _kernel_table(s, kind: str, n: int, m: int):
    """The kernel's weights at nine offsets."""
    x = s.range(9).select((F.col("id") / 9).alias("xi"))
    w = F.array(*[K.horner(p, F.col("xi")) for p in (K.lagrange(n) if kind == "lagrange" else K.spline(n, m))])
    return rounded(x.select("xi", F.posexplode(w).alias("j", "w")), ["xi", "j"], ["w"])


def _lagrange_sql(n: int) -> str:
    nodes = list(range(-n, n + 2))
    cases = " ".join(f"WHEN {j} THEN " + " * ".join(f"((xi - ({y})) / ({x} - ({y})))" for y in nodes if y != x) for j, x in enumerate(nodes))
    return f"SELECT xi, j, {r(f'CASE j {cases} END', 'w')} FROM (SELECT unnest(range(9)) / 9 AS xi), (SELECT CAST(unnest(range({2 * n + 2})) AS INTEGER) AS j)"


for _n in range(1, 11):
    query(f"p2_lagrange_n{_n}", _lagrange_sql(_n))(lambda s, d, n=_n: _kernel_table(s, "lagrange", n, 0))
# Cubic and linear splines with one neighbour, in their usual closed forms.
_CUBIC = ["-xi / 2 + xi * xi - power(xi, 3) / 2", "1 - 2.5 * xi * xi + 1.5 * power(xi, 3)", "xi / 2 + 2 * xi * xi - 1.5 * power(xi, 3)", "-xi * xi / 2 + power(xi, 3) / 2"]
_LINEAR = ["0", "1 - xi", "xi", "0"]
for _m, _forms in ((0, _LINEAR), (1, _CUBIC)):
    _cases = " ".join(f"WHEN {j} THEN {x}" for j, x in enumerate(_forms))
    query(f"p3_spline_n1_m{_m}", f"SELECT xi, j, {r(f'CASE j {_cases} END', 'w')} FROM (SELECT unnest(range(9)) / 9 AS xi), (SELECT CAST(unnest(range(4)) AS INTEGER) AS j)")(lambda s, d, m=_m: _kernel_table(s, "spline", 1, m))


def _differences(n: int, d: int) -> dict[int, float]:
    """Central weights of derivative ``d`` on 2n+1 points: Taylor coefficients of the products over the other nodes."""
    if d == 0:
        return {0: 1.0}
    rest = lambda k: sum(1 / j**2 for j in range(1, n + 1) if j != k)
    out = {}
    for k in range(1, n + 1):
        a = math.prod(j**2 / (j**2 - k**2) for j in range(1, n + 1) if j != k) / (2 * k**2)
        w = {1: a * k, 2: 2 * a, 3: -6 * a * k * rest(k), 4: -24 * a * rest(k)}[d]
        out |= {k: w, -k: w * (-1) ** d}
    if d % 2 == 0:
        out[0] = -2 * rest(0) if d == 2 else 12 * (rest(0) ** 2 - sum(1 / j**4 for j in range(1, n + 1)))
    return out


def _spline_forms(n: int, m: int) -> list[str]:
    """Weights by xi: the two-point Hermite basis in its closed form, times central differences."""
    def end(d: int, x: str, y: str) -> str:
        tail = " + ".join(f"{math.comb(m + k, k)} * power({x}, {k})" for k in range(m - d + 1))
        return f"power({x}, {d}) / {math.factorial(d)} * power({y}, {m + 1}) * ({tail})"

    forms: list[list[str]] = [[] for _ in range(2 * n + 2)]
    for d in range(m + 1):
        for k, w in _differences(n, d).items():
            forms[n + k].append(f"({w!r}) * {end(d, 'xi', '(1 - xi)')}")
            forms[n + k + 1].append(f"({w * (-1) ** d!r}) * {end(d, '(1 - xi)', 'xi')}")
    return [" + ".join(f) for f in forms]


for _n, _m in ((2, 1), (2, 2), (3, 2), (4, 4), (6, 4), (10, 4)):
    _cases = " ".join(f"WHEN {j} THEN {x}" for j, x in enumerate(_spline_forms(_n, _m)))
    query(f"p3_spline_n{_n}_m{_m}", f"SELECT xi, j, {r(f'CASE j {_cases} END', 'w')} FROM (SELECT unnest(range(9)) / 9 AS xi), (SELECT CAST(unnest(range({2 * _n + 2})) AS INTEGER) AS j)")(lambda s, d, n=_n, m=_m: _kernel_table(s, "spline", n, m))


def _first(s, d, k: int = 0):
    f = V.sig1d(s, d)
    return f.with_df(f.df.filter(F.col("snapshot") == k))


_LOC = f"loc AS (SELECT particle, x, CAST(floor(x / {_H}) AS BIGINT) AS c, x / {_H} - floor(x / {_H}) AS xi FROM pts)"


def _line_sql(forms: list[str], factor: str = "1", field: str = "sig", n: int = 1) -> str:
    cases = " ".join(f"WHEN {j} THEN {x}" for j, x in enumerate(forms))
    return f"""WITH {V.SPEC}, {V.PTS}, {_LOC} SELECT particle, {r(f'sum((CASE j {cases} END) * s.v) * {factor}', 's0')}
    FROM loc, (SELECT unnest(range({2 * n + 2})) AS j) o JOIN {field} s ON s.snapshot = 0 AND s.ix = ((c + j - {n}) % 64 + 64) % 64 GROUP BY particle, x"""


query("p5_interpolate", _line_sql(_CUBIC))(lambda s, d: rounded(P.sample(V.pts(s, d), _first(s, d), 1, 1), ["particle"], ["s0"]))
query("p12_linear", _line_sql(_LINEAR))(lambda s, d: rounded(P.sample(V.pts(s, d), _first(s, d), 0, 0), ["particle"], ["s0"]))
for _n, _m in ((2, 2), (4, 4)):
    query(f"p4_sample_n{_n}_m{_m}", _line_sql(_spline_forms(_n, _m), n=_n))(lambda s, d, n=_n, m=_m: rounded(P.sample(V.pts(s, d), _first(s, d), n, m), ["particle"], ["s0"]))
_SLOPE = ["-0.5 + 2 * xi - 1.5 * xi * xi", "-5 * xi + 4.5 * xi * xi", "0.5 + 4 * xi - 4.5 * xi * xi", "-xi + 1.5 * xi * xi"]
query("p9_derivative", _line_sql(_SLOPE, f"(1 / {_H})"))(lambda s, d: rounded(P.sample(V.pts(s, d), _first(s, d), 1, 1, (1, 0, 0)), ["particle"], ["s0"]))
_C3 = lambda v: " ".join(f"WHEN {j} THEN {x.replace('xi', v)}" for j, x in enumerate(_CUBIC))
_H4 = "(2 * pi() / 4)"
query(
    "p7_sample_vector",
    f"""WITH {V.VEC}, {V.PTS3}, loc AS (SELECT particle, {", ".join(f"CAST(floor({a} / {_H4}) AS BIGINT) AS c{a}, {a} / {_H4} - floor({a} / {_H4}) AS o{a}" for a in "xyz")} FROM pts3),
    st AS (SELECT particle, ((cx + i - 1) % 4 + 4) % 4 AS ix, ((cy + j - 1) % 4 + 4) % 4 AS iy, ((cz + k - 1) % 4 + 4) % 4 AS iz, (CASE i {_C3('ox')} END) * (CASE j {_C3('oy')} END) * (CASE k {_C3('oz')} END) AS w
      FROM loc, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j), (SELECT unnest(range(4)) AS k))
    SELECT particle, {r('sum(w * a)', 's0')}, {r('sum(w * b)', 's1')}, {r('sum(w * d)', 's2')} FROM st JOIN vec USING (iz, iy, ix) WHERE snapshot = 0 GROUP BY particle""",
)(lambda s, d: rounded(P.sample(V.orders3(s, d), (v := V.vec3d(s, d)).with_df(v.df.filter("snapshot = 0")), 1, 1), ["particle"], ["s0", "s1", "s2"]))


def _filtered(s, d):
    f = line(s, d)
    return rounded(P.filtered_samples(V.pts(s, d), f.with_df(f.df.filter("snapshot = 0")), [16.0, 8.0], 1, 1), ["particle", "kcut"], ["s0"])


_CUT = "cut AS (SELECT kcut, ix, sum((CASE WHEN kx = 0 THEN 1 ELSE 2 END) * (re * cos(2 * pi() * ((ix * kx) % 64) / 64) - im * sin(2 * pi() * ((ix * kx) % 64) / 64))) AS v FROM spec, (SELECT unnest(range(64)) AS ix), (SELECT unnest([16.0, 8.0]) AS kcut) WHERE snapshot = 0 AND kx < kcut GROUP BY ALL)"
query(
    "p10_filtered_samples",
    f"""WITH {V.SPEC}, {_CUT}, {V.PTS}, {_LOC} SELECT particle, CAST(s.kcut AS DOUBLE) AS kcut, {r(f"sum((CASE j {' '.join(f'WHEN {j} THEN {x}' for j, x in enumerate(_CUBIC))} END) * s.v)", 's0')}
    FROM loc, (SELECT unnest(range(4)) AS j) o JOIN cut s ON s.ix = ((c + j - 1) % 64 + 64) % 64 GROUP BY particle, x, s.kcut""",
)(_filtered)


#: No sum of the stored values with it lies halfway between two rounded ones.
_DT = 0.010471975511965977


#: The usual weights of orders 1 to 6, (common denominator, numerators from the present step back).
_WEIGHTS = [
    (1, (1,)), (2, (3, -1)), (12, (23, -16, 5)), (24, (55, -59, 37, -9)), (720, (1901, -2774, 2616, -1274, 251)), (1440, (4277, -7923, 9982, -7298, 2877, -475)),
]


def _steps_sql(steps: int) -> str:
    forms = []
    for k in range(1, steps + 1):
        forms.append(f"WHEN {k} THEN " + " + ".join(f"({c / _WEIGHTS[k - 1][0]!r}) * r{i}" for i, c in enumerate(_WEIGHTS[k - 1][1])))
    lags = ", ".join(f"lag(x, {k}) OVER w AS r{k}" for k in range(1, steps)) or "NULL AS none"
    return f"""WITH {V.TRAJ}, l AS (SELECT particle, step, least(row_number() OVER w, {steps}) AS "order", x AS r0, {lags} FROM traj WINDOW w AS (PARTITION BY particle ORDER BY step)),
    m AS (SELECT particle, step, "order", {_DT} * (CASE "order" {' '.join(forms)} END) AS dx FROM l)
    SELECT particle, step, "order", {r('dx', 'dx')}, {r('sum(dx) OVER (PARTITION BY particle ORDER BY step)', 'displacement')} FROM m"""


for _s in (1, 2, 4, 6):
    query(f"w3_adams_bashforth_{_s}", _steps_sql(_s))(lambda s, d, n=_s: rounded(P.integrate(V.traj(s, d), ["particle"], "step", "x", _DT, n), ["particle", "step", "order"], ["dx", "displacement"]))
query("w3_coefficients", "SELECT * FROM (VALUES (2, 0, 1.5), (2, 1, -0.5), (3, 0, round(23 / 12, 9)), (3, 1, round(-16 / 12, 9)), (3, 2, round(5 / 12, 9)), (6, 0, round(4277 / 1440, 9)), (6, 5, round(-475 / 1440, 9))) t(steps, k, c)")(
    lambda s, d: s.createDataFrame([(n, k, round(float(K.adams_bashforth(n)[k]), 9)) for n, k in ((2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (6, 0), (6, 5))], "steps int, k int, c double")
)
query(
    "w5_push",
    f"""WITH {V.TRAJ}, l AS (SELECT particle, step, x, lag(x, 1) OVER w AS a, lag(x, 2) OVER w AS b FROM traj WINDOW w AS (PARTITION BY particle ORDER BY step))
    SELECT particle, step, {r('x', 'r0')}, {r('a', 'r1')}, {r('b', 'r2')} FROM l""",
)(lambda s, d: _pushed(s, d))


def _pushed(s, d):
    """The newest three values at every step, from a ring that is pushed step by step."""
    from pyspark.sql import Window

    w = Window.partitionBy("particle").orderBy("step")
    history = F.array_compact(F.array(F.lag("x", 1).over(w), F.lag("x", 2).over(w), F.lag("x", 3).over(w)))
    ring = V.traj(s, d).select("particle", "step", P.push(history, F.col("x"), 3).alias("ring"))
    return rounded(ring.select("particle", "step", *[F.get("ring", F.lit(k)).alias(f"r{k}") for k in range(3)]), ["particle", "step"], ["r0", "r1", "r2"])


query(
    "w13_finite_difference_test",
    f"""WITH {V.TRAJ}, l AS (SELECT particle, step, x AS v, (lag(x, 2) OVER w - 8 * lag(x, 1) OVER w + 8 * lead(x, 1) OVER w - lead(x, 2) OVER w) / 12 / 0.5 AS dv FROM traj WINDOW w AS (PARTITION BY particle ORDER BY step))
    SELECT particle, count(*) AS n, {r('-10 * log10(avg((dv - v) * (dv - v)) / avg(v * v))', 'snr')} FROM l WHERE dv IS NOT NULL GROUP BY particle""",
)(lambda s, d: rounded(P.finite_difference_test(V.traj(s, d), ["particle"], "step", "x", "x", 0.5, 2), ["particle", "n"], ["snr"]))
query("w14_weights", "SELECT * FROM (VALUES (-2, round(1 / 12, 9)), (-1, round(-8 / 12, 9)), (0, 0.0), (1, round(8 / 12, 9)), (2, round(-1 / 12, 9))) t(node, w)")(
    lambda s, d: s.createDataFrame([(k, round(float(w), 9)) for k, w in zip(range(-2, 3), K.fd_weights(list(range(-2, 3)), 1))], "node int, w double")
)
for _name, _form in (("euler", "x + 0.1 * cos(x)"), ("heun", "x + 0.05 * (cos(x) + cos(x + 0.1 * cos(x)))")):
    query(f"w7_{_name}", f"WITH {V.PTS} SELECT particle, {r(_form, 'x')} FROM pts")(lambda s, d, n=_name: rounded(V.pts(s, d).select("particle", getattr(P, n)(F.col("x"), F.cos, 0.1).alias("x")), ["particle"], ["x"]))
query("w7_runge_kutta", f"WITH {V.PTS}, k AS (SELECT *, cos(x) AS a FROM pts), l AS (SELECT *, cos(x + 0.05 * a) AS b FROM k), m AS (SELECT *, cos(x + 0.05 * b) AS c FROM l) SELECT particle, {r('x + 0.1 / 6 * (a + 2 * b + 2 * c + cos(x + 0.1 * c))', 'x')} FROM m")(
    lambda s, d: rounded(V.pts(s, d).select("particle", P.runge_kutta(F.col("x"), F.cos, 0.1).alias("x")), ["particle"], ["x"])
)

_PT = "(SELECT iz, iy, ix, ix * 2 * pi() / 8 AS x, iy * 2 * pi() / 8 AS y, iz * 2 * pi() / 8 AS z FROM (SELECT CAST(unnest(range(8)) AS INTEGER) AS ix), (SELECT CAST(unnest(range(8)) AS INTEGER) AS iy), (SELECT CAST(unnest(range(8)) AS INTEGER) AS iz))"
_ABC = f"SELECT CAST(0 AS BIGINT) AS snapshot, iz, iy, ix, {r('sin(z) + 0.5 * cos(y)', 'v0')}, {r('0.7 * sin(x) + cos(z)', 'v1')}, {r('0.5 * sin(y) + 0.7 * cos(x)', 'v2')} FROM {_PT}"
query("g8_abc_flow", _ABC)(lambda s, d: rounded(G.abc_flow(s, Grid(8, 8, 8), 1.0, 0.7, 0.5).df, POINT, ["v0", "v1", "v2"]))
query("g8_abc_modes", _ABC)(lambda s, d: rounded(T.ift(G.abc_modes(s, Grid(8, 8, 8), 1.0, 0.7, 0.5)).df, POINT, ["v0", "v1", "v2"]))
# An ABC flow is its own curl.
query("k11_curl_of_abc", _ABC)(lambda s, d: rounded(T.ift(S.curl(G.abc_modes(s, Grid(8, 8, 8), 1.0, 0.7, 0.5))).df, POINT, ["v0", "v1", "v2"]))
for _dim in (0, 1, 2):
    _on = " AND ".join(f"i{a} = 0" for a in "xyz"[_dim:])
    query(f"g7_delta_{_dim}", f"SELECT CAST(0 AS BIGINT) AS snapshot, iz, iy, ix, {r(f'CASE WHEN {_on} THEN power(8 / (2 * pi()), {3 - _dim}) ELSE 0 END', 'v0')} FROM {_PT}")(lambda s, d, n=_dim: rounded(G.delta(s, Grid(8, 8, 8), n).df, POINT, ["v0"]))
query("g1_random_scalar")(lambda s, d: G.random_scalar(s, Grid(16, 16, 16)).df)
query("g2_uniform_sheet", "SELECT CAST(0 AS BIGINT) AS snapshot, ky, kz, kx, CASE WHEN ky = 0 THEN 0.5 ELSE 0.0 END AS re0, 0.0 AS im0 FROM (SELECT CAST(unnest(range(-3, 5)) AS INTEGER) AS ky), (SELECT CAST(unnest(range(-3, 5)) AS INTEGER) AS kz), (SELECT CAST(unnest(range(5)) AS INTEGER) AS kx)")(
    lambda s, d: G.uniform_sheet(s, Grid(8, 8, 8)).df
)
query("g3_random_vector")(lambda s, d: G.random_vector(s, Grid(16, 16, 16)).df)
query("g4_randomize_phases", f"WITH {V.SPEC} SELECT snapshot, kx, {r('re * re + im * im', 'power')} FROM spec")(
    lambda s, d: rounded(G.randomize_phases(line(s, d)).df.select("snapshot", "kx", (F.col("re0") * F.col("re0") + F.col("im0") * F.col("im0")).alias("power")), ["snapshot", "kx"], ["power"])
)
query("g5_tracers")(lambda s, d: G.tracers(s, 1000))
query("g6_regular_cloud", f"WITH {V.PTS3} SELECT particle AS centre, CAST(m AS INTEGER) AS member, {r('x + ((m % 3) / 2 - 0.5) * 0.3', 'x')}, {r('y + ((m // 3 % 3) / 2 - 0.5) * 0.3', 'y')}, {r('z + ((m // 9) / 2 - 0.5) * 0.3', 'z')} FROM pts3, (SELECT unnest(range(27)) AS m)")(
    lambda s, d: rounded(G.regular_cloud(V.orders3(s, d), 3, 0.3), ["centre", "member"], ["x", "y", "z"])
)
query("g6_random_cloud")(lambda s, d: G.random_cloud(V.orders3(s, d), 4, 0.1))
query("g6_lattice", f"SELECT p AS particle, {r('p % 5 * 2 * pi() / 5', 'x')}, {r('p // 5 * 2 * pi() / 5', 'y')}, 0.0 AS z FROM (SELECT unnest(range(25)) AS p)")(lambda s, d: rounded(G.lattice(s, 5), ["particle"], ["x", "y", "z"]))

_VOUT = f"WITH {V.VEC} SELECT snapshot, iz, iy, ix, {r('a', 'v0')}, {r('b', 'v1')}, {r('d', 'v2')} FROM vec"


def _stored(s, d, snapshots=None):
    path = new_path(s, "fields")
    io.write_field(V.vec3d(s, d), path, "velocity")
    return io.read_field(s, path, "velocity", V.CUBE, "real", snapshots, 3)


query("s1_snapshots", _VOUT + " WHERE snapshot IN (3, 5, 8)")(lambda s, d: rounded(_stored(s, d, [3, 5, 8]).df, POINT, ["v0", "v1", "v2"]))
query("s3_zslice", _VOUT + " WHERE iz = 0")(lambda s, d: rounded(io.zslice(_stored(s, d)).df, POINT, ["v0", "v1", "v2"]))


def _lines(s, d):
    """The series of x-lines, which has nothing else of the fields."""
    path = new_path(s, "xlines")
    io.append_xlines(V.vec3d(s, d), path, "velocity")
    return io.read_xlines(s, path, "velocity", V.CUBE, components=3)


query("s4_xline", _VOUT + " WHERE iz = 0 AND iy = 0")(lambda s, d: rounded(_lines(s, d).df, POINT, ["v0", "v1", "v2"]))


def _native(s, d) -> tuple[str, dict[int, str]]:
    """All snapshots as native files, by one job: a path for tables, and the files."""
    path = new_path(s, "native")
    name = lambda k: f"{path}-files/{io.binary_name('run', 'r', 'velocity', k)}"
    return path, {k: name(k) for k in io.write_binary(V.vec3d(s, d), name)}


def _converted(s, d):
    path, files = _native(s, d)
    io.binary_to_table(s, files, path, "velocity", V.CUBE, 3)
    return rounded(io.read_field(s, path, "velocity", V.CUBE, "real").df, POINT, ["v0", "v1", "v2"])


query("s5_binary", _VOUT)(lambda s, d: rounded(io.read_binaries(s, _native(s, d)[1], V.CUBE, 3).df, POINT, ["v0", "v1", "v2"]))
query("s9_binary_to_table", _VOUT)(_converted)


def _checkpointed(s, d):
    w, path = cube(s, d), new_path(s, "checkpoints")
    c = io.Checkpoints(s, path, Grid(4, 4, 4, dealias="smooth"), per_file=256)
    c.write_all(w)
    power = lambda part: sum((F.col(f"{part}{k}") * F.col(f"{part}{k}") for k in range(1, 3)), F.col(f"{part}0") * F.col(f"{part}0"))
    found = c.union().groupBy("snapshot").agg(F.count("*").alias("n"), F.sum(power("re") + power("im")).alias("power"))
    return rounded(found.withColumn("snapshot", F.col("snapshot").cast("long")), ["snapshot", "n"], ["power"])


query("s8_checkpoints", f"WITH {V.VSPEC} SELECT snapshot, count(*) AS n, {r('sum(ar * ar + ai * ai + br * br + bi * bi + dr * dr + di * di)', 'power')} FROM vs GROUP BY snapshot")(_checkpointed)


def _sampled_twice(s, d):
    path, rows = new_path(s, "samples"), V.traj(s, d)
    io.append_samples(rows.filter("step <= 3"), path, "x")
    io.append_samples(rows, path, "x")
    return rounded(io.read_samples(s, path, "x"), ["particle", "step"], ["x"])


query("s16_samples_once", f"WITH {V.TRAJ} SELECT particle, step, {r('x', 'x')} FROM traj")(_sampled_twice)


def _parameters(s, d):
    path = new_path(s, "parameters")
    io.write_parameters(s, path, {"name": "run", "nu": 0.1, "n": 2**31, "list": [1, 3, 5, 4]})
    return s.createDataFrame([(k, str(v)) for k, v in io.read_parameters(s, path).items()], "name string, value string")


query("s20_parameters", "SELECT * FROM (VALUES ('name', 'run'), ('nu', '0.1'), ('n', '2147483648'), ('list', '[1, 3, 5, 4]')) t(name, value)")(_parameters)


def _rfields(s, d):
    """Stored vorticity, turned into stored velocity by the job."""
    grid, at, out = Grid(8, 8, 8), new_path(s, "vorticity"), new_path(s, "velocity")
    io.write_field(G.abc_modes(s, grid, 1.0, 0.7, 0.5), at, "vorticity")
    jobs.velocity_fields(s, at, grid, [0], out)
    return rounded(io.read_field(s, out, "velocity", grid, "real", [0], 3).df, POINT, ["v0", "v1", "v2"])


query("s10_velocity_fields", _ABC)(_rfields)


def _decay(s, d):
    """An ABC flow has no nonlinear term: it decays by the viscous factor alone."""
    flow = W.Flow(viscosity=0.1, dt=0.05, forcing={"kind": "none"})
    return rounded(T.ift(W.step(G.abc_modes(s, Grid(8, 8, 8), 1.0, 0.7, 0.5), flow)).df, POINT, ["v0", "v1", "v2"])


_FALL = "exp(-0.1 * 0.05)"
query("w2_step_abc_decay", f"SELECT CAST(0 AS BIGINT) AS snapshot, iz, iy, ix, {r(f'(sin(z) + 0.5 * cos(y)) * {_FALL}', 'v0')}, {r(f'(0.7 * sin(x) + cos(z)) * {_FALL}', 'v1')}, {r(f'(0.5 * sin(y) + 0.7 * cos(x)) * {_FALL}', 'v2')} FROM {_PT}")(_decay)
