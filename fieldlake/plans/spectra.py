"""Queries of transforms, filters, calculus and grids."""

from __future__ import annotations


from pyspark.sql import functions as F

from fieldlake.functions.grid import Grid, nxmodes, shell_table
from fieldlake.model import MODE, POINT, SpectralField
from fieldlake.operators import spectral as S
from fieldlake.operators import transform as T
from fieldlake.plans import views as V

QUERIES: dict = {}
SQL: dict = {}


def rounded(df, keys, values, digits: int = 6):
    return df.select(*keys, *[(F.round(v, digits) + 0.0).alias(v) for v in values])


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def line(spark, d) -> SpectralField:
    return T.normalize(T.dft(V.sig1d(spark, d)))


def cube(spark, d) -> SpectralField:
    return T.normalize(T.dft(V.vec3d(spark, d)))


def out1(f: SpectralField):
    return rounded(f.df, ["snapshot", "kx"], f.values)


def out3(f: SpectralField):
    return rounded(f.df, list(MODE), f.values)


def line_sql(re: str, im: str, extra: str = "") -> str:
    return f"WITH {V.SPEC}{extra} SELECT snapshot, kx, {r(re, 're0')}, {r(im, 'im0')} FROM spec"


_KEYS = "snapshot, ky, kz, kx"


def cube_sql(pairs: list[tuple[str, str]], source: str = "vs", extra: str = "", base: str = V.VSPEC) -> str:
    cols = ", ".join(f"{r(re, f're{c}')}, {r(im, f'im{c}')}" for c, (re, im) in enumerate(pairs))
    return f"WITH {base}{extra} SELECT {_KEYS}, {cols} FROM {source}"


query("t1_dft", line_sql("re * 64", "im * 64"))(lambda s, d: out1(T.dft(V.sig1d(s, d))))
query("t1_dft_sums", line_sql("re * 64", "im * 64"))(lambda s, d: out1(T.dft_sums(V.sig1d(s, d))))
query("t1_dft_3d", cube_sql([("vr * 64", "vi * 64")], "ss", base=V.SSPEC))(lambda s, d: out3(T.dft(V.scal3d(s, d))))
query("t2_ift", f"WITH {V.SIG} SELECT snapshot, ix, {r('v', 'v0')} FROM sig")(lambda s, d: rounded(T.ift(line(s, d)).df, ["snapshot", "ix"], ["v0"]))
query("t2_ift_3d", f"WITH {V.VEC} SELECT snapshot, iz, iy, ix, {r('a', 'v0')}, {r('b', 'v1')}, {r('d', 'v2')} FROM vec")(lambda s, d: rounded(T.ift(cube(s, d)).df, POINT, ["v0", "v1", "v2"]))
query("t3_normalize", cube_sql([("ar", "ai"), ("br", "bi"), ("dr", "di")]))(lambda s, d: out3(cube(s, d)))
query("t5_transpose", f"WITH {V.SCAL} SELECT snapshot, ix AS iz, iz AS iy, iy AS ix, {r('v', 'v0')} FROM sc")(lambda s, d: rounded(T.transpose(V.scal3d(s, d), "yzx").df, POINT, ["v0"]))
query("t6_interleave", f"WITH {V.VEC} SELECT snapshot, iz, iy, ix, {r('a', 'v0')}, {r('b', 'v1')}, {r('d', 'v2')} FROM vec")(
    lambda s, d: rounded(T.separate(T.interleave(V.vec3d(s, d)), V.CUBE, 3).df, POINT, ["v0", "v1", "v2"])
)
query("t6_slabs", f"WITH {V.VEC} SELECT snapshot, iz, iy, ix, {r('a', 'v0')}, {r('b', 'v1')}, {r('d', 'v2')} FROM vec")(
    lambda s, d: rounded(T.from_slabs(T.to_slabs(V.vec3d(s, d)), V.CUBE, 3).df, POINT, ["v0", "v1", "v2"])
)
query("t7_frames", f"WITH {V.VEC} SELECT snapshot, c, iz, iy, ix, {r('CASE c WHEN 0 THEN a WHEN 1 THEN b ELSE d END', 'v')} FROM vec, (SELECT unnest(range(3)) AS c)")(
    lambda s, d: rounded(T.frames(V.vec3d(s, d)), ["snapshot", "c", "iz", "iy", "ix"], ["v"])
)

_SHELLS = """
WITH m AS (SELECT kx, CASE WHEN kx = 0 THEN 1 ELSE 2 END AS n FROM (SELECT unnest(range(33)) AS kx) WHERE kx < 31)
SELECT s AS shell, {0}, CAST(coalesce(sum(n), 0) AS BIGINT) AS nshell FROM (SELECT unnest(range(33)) AS s) LEFT JOIN m ON m.kx = s GROUP BY s
""".format(r("coalesce(sum(n * kx) / sum(n), 0)", "kshell"))
query("k1_shells", _SHELLS)(lambda s, d: rounded(shell_table(Grid(64), s), ["shell", "nshell"], ["kshell"]))
_SHELLS3 = """
WITH m AS (SELECT floor(sqrt(k2)) AS s, sqrt(k2) AS k, CASE WHEN kx = 0 THEN 1 ELSE 2 END AS n FROM (
  SELECT kx, kx * kx + ky * ky + kz * kz AS k2 FROM (SELECT unnest(range(-7, 9)) AS ky), (SELECT unnest(range(-7, 9)) AS kz), (SELECT unnest(range(0, 9)) AS kx)) WHERE k2 < 49)
SELECT e.s AS shell, {0}, CAST(coalesce(sum(n), 0) AS BIGINT) AS nshell FROM (SELECT unnest(range(9)) AS s) e LEFT JOIN m ON m.s = e.s GROUP BY e.s
""".format(r("coalesce(sum(n * k) / sum(n), 0)", "kshell"))
query("k1_shells_3d", _SHELLS3)(lambda s, d: rounded(shell_table(Grid(16, 16, 16), s), ["shell", "nshell"], ["kshell"]))
query("k2_low_pass", line_sql("CASE WHEN kx < 20 THEN re ELSE 0 END", "CASE WHEN kx < 20 THEN im ELSE 0 END"))(lambda s, d: out1(S.low_pass(line(s, d), 20)))
query("k2_low_pass_sparse", line_sql("re", "im") + " WHERE kx < 20")(lambda s, d: out1(S.low_pass_sparse(line(s, d), 20)))
_GAUSS = "exp(-0.5 * {0} * {0} * kx * kx)"
query("k3_gauss", line_sql(f"re * {_GAUSS.format(0.1)}", f"im * {_GAUSS.format(0.1)}"))(lambda s, d: out1(S.gauss_filter(line(s, d), 0.1)))


def _ball(length) -> str:
    x = f"(kx * {length} / 2)"
    return f"(CASE WHEN kx = 0 THEN 1 ELSE 3 * (sin{x} - {x} * cos{x}) / power(CASE WHEN kx = 0 THEN 1 ELSE {x} END, 3) END)"


query("k4_ball", line_sql(f"re * {_ball(0.3)}", f"im * {_ball(0.3)}"))(lambda s, d: out1(S.ball_filter(line(s, d), 0.3)))
for _kind, _at, _len in (
    ("sharp_Fourier_sphere", "(CASE WHEN kx < 8 THEN 1 ELSE 0 END)", "(CASE WHEN kx < 2.8 / 0.5 THEN 1 ELSE 0 END)"),
    ("Gauss", _GAUSS.format("(pi() / 8)"), _GAUSS.format("(0.23 * 0.5)")),
    ("ball", _ball("(pi() / 8)"), _ball("0.5")),
):
    query(f"k5a_filter_{_kind.split('_')[0].lower()}", line_sql(f"re * {_at}", f"im * {_at}"))(lambda s, d, k=_kind: out1(S.filter_at(line(s, d), 8, k)))
    query(f"k5b_calibrated_{_kind.split('_')[0].lower()}", line_sql(f"re * {_len}", f"im * {_len}"))(lambda s, d, k=_kind: out1(S.filter_length(line(s, d), 0.5, k)))
_SMOOTH = "exp(-36 * power(kx * kx / (31.0 * 31.0), 18))"
query("k5c_dealias_smooth", line_sql(f"re * {_SMOOTH}", f"im * {_SMOOTH}"))(lambda s, d: out1(S.dealias(line(s, d))))
query("k5c_dealias_two_thirds", line_sql("CASE WHEN kx < 20 THEN re ELSE 0 END", "CASE WHEN kx < 20 THEN im ELSE 0 END"))(
    lambda s, d: out1(S.dealias(SpectralField(line(s, d).df, Grid(64, dealias="two_thirds"), 1)))
)

_DOT = {p: f"(kx * a{p} + ky * b{p} + kz * d{p})" for p in "ri"}
query("k6_divergence_free", cube_sql([tuple(f"CASE WHEN k2 > 0 THEN {n}{p} - {k} * {_DOT[p]} / k2 ELSE 0 END" for p in "ri") for n, k in (("a", "kx"), ("b", "ky"), ("d", "kz"))]))(lambda s, d: out3(S.divergence_free(cube(s, d))))


def _bent(s, d) -> SpectralField:
    """A field without the symmetry, to be given it."""
    f = T.normalize(T.dft(V.scal3d(s, d)))
    return f.map((F.col("re0") * (2 + F.col("ky")) + 0.1 * F.col("kz"), F.col("im0") + 0.5))


_BENT = "bent AS (SELECT snapshot, ky, kz, kx, vr * (2 + ky) + 0.1 * kz AS x, vi + 0.5 AS y FROM ss)"
query(
    "k7_symmetrize",
    f"""WITH {V.SSPEC}, {_BENT}, p AS (SELECT snapshot, -ky AS ky, -kz AS kz, kx, x, y FROM bent WHERE kx = 0 AND abs(ky) < 2 AND abs(kz) < 2 AND (ky > 0 OR ky = 0 AND kz > 0))
    SELECT b.snapshot, b.ky, b.kz, b.kx, {r('coalesce(p.x, b.x)', 're0')}, {r('CASE WHEN b.kx = 0 AND b.ky = 0 AND b.kz = 0 THEN 0 ELSE coalesce(-p.y, b.y) END', 'im0')}
    FROM bent b LEFT JOIN p ON p.snapshot = b.snapshot AND p.ky = b.ky AND p.kz = b.kz AND p.kx = b.kx""",
)(lambda s, d: out3(S.symmetrize(_bent(s, d))))
query("k8_zero_mode", cube_sql([("CASE WHEN k2 = 0 THEN 0 ELSE vr END", "CASE WHEN k2 = 0 THEN 0 ELSE vi END")], "ss", base=V.SSPEC))(lambda s, d: out3(S.zero_mode(T.normalize(T.dft(V.scal3d(s, d))))))
# On 4 points only the mean lies within km: the gradient is checked on the line, where km is 31.
query("k9_gradient", f"WITH {V.SPEC} SELECT snapshot, kx, {r('CASE WHEN kx < 31 THEN -kx * im ELSE 0 END', 're0')}, {r('CASE WHEN kx < 31 THEN kx * re ELSE 0 END', 'im0')}, 0.0 AS re1, 0.0 AS im1, 0.0 AS re2, 0.0 AS im2 FROM spec")(
    lambda s, d: out1(S.gradient(line(s, d)))
)




def _curl_sql(scale: str, inside: str) -> list[tuple[str, str]]:
    out = []
    for (k1, b), (k2_, c) in ((("ky", "d"), ("kz", "b")), (("kz", "a"), ("kx", "d")), (("kx", "b"), ("ky", "a"))):
        re, im = f"-({k1} * {b}i - {k2_} * {c}i)", f"({k1} * {b}r - {k2_} * {c}r)"
        out.append(tuple(f"CASE WHEN {inside} THEN {x} * {scale} ELSE 0 END" for x in (re, im)))
    return out


query("k10_invert_curl", cube_sql(_curl_sql("(1.0 / k2)", "k2 > 0 AND k2 <= 1")))(lambda s, d: out3(S.invert_curl(cube(s, d))))
query("k11_curl", cube_sql(_curl_sql("1.0", "k2 <= 1")))(lambda s, d: out3(S.curl(cube(s, d))))

_SMOOTH3 = "exp(-36 * power(k2, 18))"
_UU = f"""vec6 AS (SELECT snapshot, iz, iy, ix, a * a AS p0, b * b AS p1, d * d AS p2, a * b AS p3, b * d AS p4, d * a AS p5 FROM vec), raw AS ({V.sums('vec6', [f'p{k}' for k in range(6)])}),
uu AS (SELECT snapshot, ky, kz, kx, k2, {", ".join(f"p{k}{p} * {_SMOOTH3} AS p{k}{p}" for k in range(6) for p in "ri")} FROM raw)"""
_KK = {p: f"(kx * kx * p0{p} + ky * ky * p1{p} + kz * kz * p2{p} + 2 * (kx * ky * p3{p} + ky * kz * p4{p} + kz * kx * p5{p}))" for p in "ri"}
_PR = f"pr AS (SELECT {_KEYS}, k2, CASE WHEN k2 > 0 AND k2 <= 1 THEN -{_KK['r']} / k2 ELSE 0 END AS qr, CASE WHEN k2 > 0 AND k2 <= 1 THEN -{_KK['i']} / k2 ELSE 0 END AS qi FROM uu)"
query("k12_pressure", cube_sql([("qr", "qi")], "pr", f", {_UU}, {_PR}"))(lambda s, d: out3(S.pressure(V.vec3d(s, d))))
_LINEAR = {"kind": "linear", "amplitude": 0.5, "k0": 1.0, "k1": 2.0}
_RATE = "(-0.1 * k2 + CASE WHEN sqrt(k2) BETWEEN 1 AND 2 THEN 0.5 ELSE 0 END)"
_LA = [(f"CASE WHEN k2 <= 1 THEN {n}r * {_RATE} + {k} * qi ELSE 0 END", f"CASE WHEN k2 <= 1 THEN {n}i * {_RATE} - {k} * qr ELSE 0 END") for n, k in (("a", "kx"), ("b", "ky"), ("d", "kz"))]
query("k13_lagrangian_acceleration", cube_sql(_LA, "(SELECT vs.*, qr, qi FROM vs JOIN pr USING (snapshot, ky, kz, kx))", f", {_UU}, {_PR}"))(
    lambda s, d: out3(S.lagrangian_acceleration(cube(s, d), S.pressure(V.vec3d(s, d)), 0.1, _LINEAR))
)
_ROW = {"a": ("p0", "p3", "p5"), "b": ("p3", "p1", "p4"), "d": ("p5", "p4", "p2")}
_EU = ", ".join(
    f"CASE WHEN k2 <= 1 THEN {n}r * {_RATE} + (kx * {x}i + ky * {y}i + kz * {z}i) ELSE 0 END AS {n}r, CASE WHEN k2 <= 1 THEN {n}i * {_RATE} - (kx * {x}r + ky * {y}r + kz * {z}r) ELSE 0 END AS {n}i" for n, (x, y, z) in _ROW.items()
)
query(
    "k14_eulerian_acceleration",
    cube_sql([tuple(f"CASE WHEN k2 > 0 THEN {n}{p} - {k} * {_DOT[p]} / k2 ELSE 0 END" for p in "ri") for n, k in (("a", "kx"), ("b", "ky"), ("d", "kz"))], "eu", f", {_UU}, eu AS (SELECT {_KEYS}, vs.k2, {_EU} FROM vs JOIN (SELECT * EXCLUDE (k2) FROM uu) USING (snapshot, ky, kz, kx))"),
)(lambda s, d: out3(S.eulerian_acceleration(cube(s, d), S.products(V.vec3d(s, d)), 0.1, _LINEAR)))
query("k15_forcing_kolmogorov", cube_sql([("ar", "ai"), ("br", "bi"), ("dr - CASE WHEN kx = 0 AND kz = 0 AND abs(ky) = 1 THEN 0.25 ELSE 0 END", "di")]))(
    lambda s, d: out3(S.add_forcing(f := cube(s, d), f, 1.0, {"kind": "Kolmogorov", "amplitude": 0.5, "mode": 1}))
)
_F = "(1 + CASE WHEN sqrt(k2) BETWEEN 1 AND 2 THEN 0.25 ELSE 0 END)"
query("k15_forcing_linear", cube_sql([tuple(f"{n}{p} * {_F}" for p in "ri") for n in "abd"]))(lambda s, d: out3(S.add_forcing(f := cube(s, d), f, 0.5, _LINEAR)))
query(
    "r2_resize_up",
    f"""WITH {V.SSPEC}, g AS (SELECT snapshot, ky, kz, kx FROM (SELECT DISTINCT vec_id AS snapshot FROM embeddings), (SELECT unnest(range(-2, 4)) AS ky), (SELECT unnest(range(-2, 4)) AS kz), (SELECT unnest(range(0, 4)) AS kx))
    SELECT g.snapshot, g.ky, g.kz, g.kx, {r('coalesce(vr, 0)', 're0')}, {r('coalesce(vi, 0)', 'im0')} FROM g LEFT JOIN ss USING (snapshot, ky, kz, kx)""",
)(lambda s, d: out3(S.resize(T.normalize(T.dft(V.scal3d(s, d))), Grid(6, 6, 6))))
query("r3_resize_down", line_sql("re", "im") + " WHERE kx <= 16")(lambda s, d: out1(S.resize(line(s, d), Grid(32))))
query("g10_modes", f"WITH {V.MODES} SELECT ky, kz, kx, CASE WHEN kx = 0 THEN 1 ELSE 2 END AS n, CAST(floor(sqrt(k2)) AS INTEGER) AS shell FROM modes")(lambda s, d: V.CUBE.modes(s).select("ky", "kz", "kx", nxmodes().alias("n"), V.CUBE.shell.alias("shell")))
query("g9_coordinates", f"SELECT i AS ix, {r('i * 2 * pi() / 64', 'x')} FROM (SELECT CAST(unnest(range(64)) AS INTEGER) AS i)")(lambda s, d: rounded(Grid(64).coordinates(s, "x"), ["ix"], ["x"]))
