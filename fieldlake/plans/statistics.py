"""Queries of moments, histograms, spectra, maps and derived statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.functions.grid import Grid, shell_table
from fieldlake.model import POINT, RealField
from fieldlake.operators import derived as D
from fieldlake.operators import spectral as S
from fieldlake.operators import stats as A
from fieldlake.operators import transform as T
from fieldlake.plans import views as V
from fieldlake.plans.spectra import cube, line, r, rounded

QUERIES: dict = {}
SQL: dict = {}

_M = ["min", *[f"m{n}" for n in range(1, 9)], "max"]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def moment_sql(v: str, lo: str = "min({0})", hi: str = "max({0})") -> str:
    return ", ".join([r(lo.format(v), '"min"'), *[r(f"avg(power({v}, {n}))", f"m{n}") for n in range(1, 9)], r(hi.format(v), '"max"')])


_LONG = """long AS (SELECT snapshot, component, CASE component WHEN 'x' THEN a WHEN 'y' THEN b WHEN 'z' THEN d ELSE sqrt(a * a + b * b + d * d) END AS v
  FROM vec, (SELECT unnest(['x', 'y', 'z', 'm']) AS component))"""
query("a1_moments", f"WITH {V.VEC}, {_LONG} SELECT snapshot, component, {moment_sql('v')} FROM long GROUP BY snapshot, component")(lambda s, d: rounded(A.moments(V.vec3d(s, d)), ["snapshot", "component"], _M))
query("a1q_moments_compat", f"WITH {V.VEC}, {_LONG} SELECT snapshot, component, {moment_sql('v', 'least(min({0}), 0)', 'greatest(max({0}), 0)')} FROM long GROUP BY snapshot, component")(
    lambda s, d: rounded(A.moments(V.vec3d(s, d), compat=True), ["snapshot", "component"], _M)
)
query("a1_moments_lineitem", f"SELECT l_returnflag, l_linestatus, {moment_sql('(l_quantity / 50)')} FROM lineitem GROUP BY ALL")(
    lambda s, d: rounded(A.value_moments(V.table(s, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") / 50).alias("q")), ["l_returnflag", "l_linestatus"], "q"), ["l_returnflag", "l_linestatus"], _M)
)
query("a1_moments_prices", f"SELECT n_name, {moment_sql('(o_totalprice / 500000)')} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")(
    lambda s, d: rounded(
        A.value_moments(
            V.table(s, d, "orders").join(V.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(V.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", (F.col("o_totalprice") / 500000).alias("v")),
            ["n_name"], "v",
        ), ["n_name"], _M,
    )
)
_BIN = "CASE WHEN component = 'm' THEN floor(v * 16 / 0.8) ELSE floor((v + 0.4) / (2 * 0.4 / 16)) END"
query(
    "a2_histogram",
    f"""WITH {V.VEC}, {_LONG}, c AS (SELECT snapshot, component, {_BIN} AS bin, count(*) AS cnt FROM long GROUP BY ALL)
    SELECT e.snapshot, e.component, e.bin, coalesce(cnt, 0) AS cnt FROM (SELECT snapshot, component, bin FROM (SELECT DISTINCT snapshot FROM vec), (SELECT unnest(['x', 'y', 'z', 'm']) AS component), (SELECT unnest(range(16)) AS bin)) e
    LEFT JOIN c ON c.snapshot = e.snapshot AND c.component = e.component AND c.bin = e.bin""",
)(lambda s, d: A.histogram(V.vec3d(s, d), [0.4, 0.4, 0.4, 0.8], 16))
query("a2_histogram_line", f"WITH {V.SIG} SELECT snapshot, 's' AS component, CAST(floor((v + 0.3) / (2 * 0.3 / 8)) AS INTEGER) AS bin, count(*) AS cnt FROM sig WHERE floor((v + 0.3) / (2 * 0.3 / 8)) BETWEEN 0 AND 7 GROUP BY ALL")(
    lambda s, d: A.histogram(V.sig1d(s, d), [0.3], 8, fill=False)
)
_COS = {(i, j): f"(CASE WHEN kx = 0 THEN 1 ELSE 2 END) * ({a}r * {b}r + {a}i * {b}i)" for i, a in enumerate("abd") for j, b in enumerate("abd")}
_CSQL = " UNION ALL ".join(f"SELECT snapshot, CAST(floor(sqrt(k2)) AS INTEGER) AS shell, {i} AS i, {j} AS j, {r(f'sum({e})', 'value')} FROM vs WHERE k2 <= 1 GROUP BY snapshot, floor(sqrt(k2))" for (i, j), e in _COS.items())
query("a4_cospectrum", f"WITH {V.VSPEC} {_CSQL}")(lambda s, d: rounded(A.cospectrum(cube(s, d)), ["snapshot", "shell", "i", "j"], ["value"]))
query("a4_cospectrum_pair", f"WITH {V.SPEC} SELECT snapshot, kx AS shell, 0 AS i, 0 AS j, {r('nx * (re * re + im * im) * exp(-0.5 * 0.1 * 0.1 * kx * kx)', 'value')} FROM spec WHERE kx <= 31")(
    lambda s, d: rounded(A.cospectrum(f := line(s, d), S.gauss_filter(f, 0.1)), ["snapshot", "shell", "i", "j"], ["value"])
)
query("a5_weighted_spectrum", f"WITH {V.SPEC} SELECT snapshot, kx AS shell, 0 AS i, 0 AS j, {r('nx * (re * re + im * im) * power(kx * kx, 0.5)', 'value')} FROM spec WHERE kx <= 31")(
    lambda s, d: rounded(A.cospectrum(line(s, d), k2exponent=0.5), ["snapshot", "shell", "i", "j"], ["value"])
)
query("a6_autocorrelation", f"WITH {V.SPEC} SELECT snapshot, {r('sum(nx * (re * re + im * im))', 'value')} FROM spec WHERE kx <= 31 GROUP BY snapshot")(lambda s, d: rounded(A.autocorrelation(line(s, d)), ["snapshot"], ["value"]))


def _next(f: RealField) -> RealField:
    """The field of the next snapshot at each point."""
    return f.with_df(f.df.withColumn("snapshot", F.col("snapshot") - 1))


_JB = lambda x, lim: f"CAST(floor(({x} + {lim} / sqrt(3)) / (2 * ({lim} / sqrt(3)) / 8)) AS INTEGER)"
_JM = lambda t, lim: f"CAST(floor(sqrt({t}.a * {t}.a + {t}.b * {t}.b + {t}.d * {t}.d) * 8 / {lim}) AS INTEGER)"
_JITEMS = " UNION ALL ".join(
    [f"SELECT p.snapshot, '{n}' AS comp1, '{m}' AS comp2, {_JB(f'p.{a}', 0.7)} AS bin1, {_JB(f'q.{b}', 0.6)} AS bin2 FROM vec p JOIN vec q ON q.snapshot - 1 = p.snapshot AND q.iz = p.iz AND q.iy = p.iy AND q.ix = p.ix" for n, a in zip("xyz", "abd") for m, b in zip("xyz", "abd")]
    + [f"SELECT p.snapshot, 'm' AS comp1, 'm' AS comp2, {_JM('p', 0.7)} AS bin1, {_JM('q', 0.6)} AS bin2 FROM vec p JOIN vec q ON q.snapshot - 1 = p.snapshot AND q.iz = p.iz AND q.iy = p.iy AND q.ix = p.ix"]
)
query("a7_joint_histogram", f"WITH {V.VEC}, j AS ({_JITEMS}) SELECT snapshot, comp1, comp2, bin1, bin2, count(*) AS cnt FROM j WHERE bin1 BETWEEN 0 AND 7 AND bin2 BETWEEN 0 AND 7 GROUP BY ALL")(
    lambda s, d: A.joint_histogram(v := V.vec3d(s, d), _next(v), 0.7, 0.6, 8)
)
query("a7_joint_lineitem", "SELECT l_returnflag, 'q' AS comp1, 'p' AS comp2, CAST(floor(l_quantity * 20 / 50.0) AS INTEGER) AS bin1, CAST(floor(l_extendedprice * 20 / 100000.0) AS INTEGER) AS bin2, count(*) AS cnt FROM lineitem WHERE floor(l_quantity * 20 / 50.0) BETWEEN 0 AND 19 AND floor(l_extendedprice * 20 / 100000.0) BETWEEN 0 AND 19 GROUP BY ALL")(
    lambda s, d: A.joint_counts(V.table(s, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p")), ["l_returnflag"], "q", "p", 50.0, 100000.0, 20)
)
query("a10_mean", f"WITH {V.VEC} SELECT snapshot, {r('avg(a)', 'v0')}, {r('avg(b)', 'v1')}, {r('avg(d)', 'v2')} FROM vec GROUP BY snapshot")(lambda s, d: rounded(A.mean(V.vec3d(s, d)), ["snapshot"], ["v0", "v1", "v2"]))
query("a11_time_average", f"WITH {V.SIG} SELECT ix, {r('avg(v)', 'v0')} FROM sig GROUP BY ix")(lambda s, d: rounded(A.time_average(V.sig1d(s, d).df, ["ix"], ["v0"]), ["ix"], ["v0"]))
_X = [("p.b * q.d - p.d * q.b"), ("p.d * q.a - p.a * q.d"), ("p.a * q.b - p.b * q.a")]
query("r1_cross_product", f"WITH {V.VEC} SELECT p.snapshot, p.iz, p.iy, p.ix, {', '.join(r(f'({x}) / 64', f'v{k}') for k, x in enumerate(_X))} FROM vec p JOIN vec q ON q.snapshot - 1 = p.snapshot AND q.iz = p.iz AND q.iy = p.iy AND q.ix = p.ix")(
    lambda s, d: rounded(A.cross_product(v := V.vec3d(s, d), _next(v)).df, POINT, ["v0", "v1", "v2"])
)
query("r5_increments", f"WITH {V.SIG} SELECT p.snapshot, p.ix, {r('q.v - p.v', 'v0')} FROM sig p JOIN sig q ON q.snapshot = p.snapshot AND q.ix = (p.ix + 5) % 64")(lambda s, d: rounded(A.increments(V.sig1d(s, d), 5).df, ["snapshot", "ix"], ["v0"]))
query("r5_increment_moments", f"WITH {V.SIG}, i AS (SELECT p.snapshot, q.v - p.v AS v FROM sig p JOIN sig q ON q.snapshot = p.snapshot AND q.ix = (p.ix + 5) % 64) SELECT snapshot, 's' AS component, {moment_sql('v')} FROM i GROUP BY snapshot")(
    lambda s, d: rounded(A.moments(A.increments(V.sig1d(s, d), 5)), ["snapshot", "component"], _M)
)


def _nine(s, d) -> RealField:
    """Nine values at each point, standing for a gradient: the components of three snapshots in a row."""
    v = V.vec3d(s, d)
    p, q = _next(v), _next(_next(v))
    df = v.df
    for k, o in ((3, p), (6, q)):
        df = df.join(o.df.select(*POINT, *[F.col(f"v{c}").alias(f"v{k + c}") for c in range(3)]), list(POINT))
    return RealField(df, v.grid, 9)


_A = {(i, c): f"{t}.{n}" for i, t in enumerate("pqs") for c, n in enumerate("abd")}
_N = ", ".join(f"{e} AS g{i}{c}" for (i, c), e in _A.items())
_NINE = f"nine AS (SELECT p.snapshot, p.iz, p.iy, p.ix, {_N} FROM vec p JOIN vec q ON q.snapshot - 1 = p.snapshot AND q.iz = p.iz AND q.iy = p.iy AND q.ix = p.ix JOIN vec s ON s.snapshot - 2 = p.snapshot AND s.iz = p.iz AND s.iy = p.iy AND s.ix = p.ix)"
# By the traces' definitions: tr(S S), -tr(A A) / 2, -tr(A A A) / 3.
_TR_S2 = " + ".join(f"power((g{i}{j} + g{j}{i}) / 2, 2)" for i in range(3) for j in range(3))
_Q = "-0.5 * (" + " + ".join(f"g{i}{j} * g{j}{i}" for i in range(3) for j in range(3)) + ")"
_R = "-(" + " + ".join(f"g{i}{j} * g{j}{k} * g{k}{i}" for i in range(3) for j in range(3) for k in range(3)) + ") / 3"
query("r6_gradient_invariants", f"WITH {V.VEC}, {_NINE} SELECT snapshot, iz, iy, ix, {r(_TR_S2, 'v0')}, {r(_Q, 'v1')}, {r(_R, 'v2')} FROM nine")(lambda s, d: rounded(A.gradient_invariants(_nine(s, d)).df, POINT, ["v0", "v1", "v2"]))
query("r7_enstrophy", f"WITH {V.VEC} SELECT snapshot, iz, iy, ix, {r('0.5 * (a * a + b * b + d * d)', 'v0')} FROM vec")(lambda s, d: rounded(A.enstrophy(V.vec3d(s, d)).df, POINT, ["v0"]))
query("r7_enstrophy_mean", f"WITH {V.VEC} SELECT snapshot, {r('avg(0.5 * (a * a + b * b + d * d))', 'v0')} FROM vec GROUP BY snapshot")(lambda s, d: rounded(A.mean(A.enstrophy(V.vec3d(s, d))), ["snapshot"], ["v0"]))
query("r8_cut", f"WITH {V.VEC} SELECT snapshot, iz, iy, ix, {r('0.5 * (a * a + b * b + d * d)', 'v0')} FROM vec WHERE iy = 1")(lambda s, d: rounded(A.cut(V.vec3d(s, d), 1).df, POINT, ["v0"]))
query("r9_map", f"WITH {V.SIG} SELECT snapshot, ix, {r('v * v - 0.1', 'v0')} FROM sig")(lambda s, d: rounded((f := V.sig1d(s, d)).map(F.col("v0") * F.col("v0") - 0.1).df, ["snapshot", "ix"], ["v0"]))

# Derived statistics: the line's spectrum stands for velocity, its weighted spectrum for vorticity.
_ENERGY = "en AS (SELECT snapshot, kx AS shell, nx * (re * re + im * im) / 2 AS e, kx * kx * nx * (re * re + im * im) / 2 AS z FROM spec WHERE kx <= 31)"


def _energies(s, d):
    f = line(s, d)
    return D.shell_energy(A.cospectrum(f)), D.shell_energy(A.cospectrum(f, k2exponent=1.0))


query("d1_shell_energy", f"WITH {V.SPEC}, {_ENERGY} SELECT snapshot, shell, {r('e', 'energy')} FROM en")(lambda s, d: rounded(_energies(s, d)[0], ["snapshot", "shell"], ["energy"]))
query("d2_times", f"WITH {V.VEC} SELECT snapshot, {r('snapshot * 0.01', 't')}, {r('max(sqrt(a * a + b * b + d * d))', 'vel_max')}, {r('avg(a * a + b * b + d * d) / 2', 'renergy')} FROM vec GROUP BY snapshot")(
    lambda s, d: rounded(D.times(A.moments(V.vec3d(s, d)), 0.01), ["snapshot"], ["t", "vel_max", "renergy"])
)
_SERIES = ["energy", "enstrophy", "Uint", "Lint", "diss", "etaK", "tauK", "Re", "lambda", "Rlambda", "kMeta", "Tint", "Taylor_microscale"]
_SCALES = """SELECT {keys}{round} FROM (SELECT *, 2 * 0.1 * Z AS eps FROM base) """
_RO = {
    "energy": "E", "enstrophy": "Z", "Uint": "U", "Lint": "L", "diss": "eps", "etaK": "power(power(0.1, 3) / nullif(eps, 0), 0.25)", "tauK": "sqrt(0.1 / nullif(eps, 0))", "Re": "U * L / 0.1", "lambda": "sqrt(15 * 0.1 * U * U / nullif(eps, 0))",
    "Rlambda": "U * sqrt(15 * 0.1 * U * U / nullif(eps, 0)) / 0.1", "kMeta": "31 * 0.8 * power(power(0.1, 3) / nullif(eps, 0), 0.25)", "Tint": "L / nullif(U, 0)", "Taylor_microscale": "sqrt(15 * 0.1 * U * U / nullif(eps, 0))",
}
_BASE = f"WITH {V.SPEC}, {_ENERGY}, sums AS (SELECT snapshot, sum(e) AS E, sum(z) AS Z, sum(CASE WHEN shell BETWEEN 1 AND 30 THEN e / shell END) AS ratio FROM en GROUP BY snapshot), series AS (SELECT snapshot, E, Z, sqrt(2 * E / 3) AS U, pi() * ratio / nullif(2 * (2 * E / 3), 0) AS L FROM sums)"
query("d3_to_d8_series", f"{_BASE}, base AS (SELECT * FROM series) " + _SCALES.format(keys="snapshot, ", round=", ".join(r(e, f'"{n}"') for n, e in _RO.items())))(
    lambda s, d: rounded(D.per_time(*_energies(s, d), shell_table(Grid(64), s), Grid(64), 0.1), ["snapshot"], _SERIES)
)
query("d6_to_d8_averaged", f"{_BASE}, base AS (SELECT avg(E) AS E, avg(Z) AS Z, avg(U) AS U, avg(L) AS L FROM series) " + _SCALES.format(keys="", round=", ".join(r(e, f'"{n}"') for n, e in _RO.items())))(
    lambda s, d: rounded(D.averaged(D.per_time(*_energies(s, d), shell_table(Grid(64), s), Grid(64), 0.1), Grid(64), 0.1), [], _SERIES)
)
query("d10_window", f"WITH {V.SPEC}, {_ENERGY} SELECT snapshot, {r('sum(e)', 'energy')} FROM en WHERE snapshot BETWEEN 20 AND 60 GROUP BY snapshot")(
    lambda s, d: rounded(D.window(_energies(s, d)[0], 20, 60).groupBy("snapshot").agg(F.sum("energy").alias("energy")), ["snapshot"], ["energy"])
)
query("d13_courant", f"WITH {V.VEC} SELECT snapshot, {r('0.01 * max(sqrt(a * a + b * b + d * d)) / (2 * pi() / 4)', 'courant')} FROM vec GROUP BY snapshot")(lambda s, d: rounded(D.courant(A.moments(V.vec3d(s, d)), V.CUBE, 0.01), ["snapshot"], ["courant"]))
