"""Queries of runs, jobs, stored tables and statistics that are made of several operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.functions.grid import Grid
from fieldlake.model import MODE, POINT, RealField, SpectralField
from fieldlake.operators import derived as D
from fieldlake.operators import dynamics as W
from fieldlake.operators import generate as G
from fieldlake.operators import particles as P
from fieldlake.operators import spectral as S
from fieldlake.operators import stats as A
from fieldlake.operators import transform as T
from fieldlake.plans import jobs, motion, spectra, statistics
from fieldlake.plans import views as V
from fieldlake.plans.spectra import cube, out3, r, rounded
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


def points_sql(n: int) -> str:
    axis = f"(SELECT CAST(unnest(range({n})) AS INTEGER) AS {{0}})"
    at = ", ".join(f"i{a} * 2 * pi() / {n} AS {a}" for a in "xyz")
    return f"(SELECT iz, iy, ix, {at} FROM {axis.format('ix')}, {axis.format('iy')}, {axis.format('iz')})"


_GRID = Grid(8, 8, 8)
_ABC = {"a": "(sin(z) + 0.5 * cos(y))", "b": "(0.7 * sin(x) + cos(z))", "d": "(0.5 * sin(y) + 0.7 * cos(x))"}


def _abc(s) -> SpectralField:
    return G.abc_modes(s, _GRID, 1.0, 0.7, 0.5)


# A Taylor-Green vortex, by its closed forms: velocity, vorticity and their gradients.
_U = ["sin(x) * cos(y) * cos(z)", "-cos(x) * sin(y) * cos(z)", "0"]
_O = ["-cos(x) * sin(y) * sin(z)", "-sin(x) * cos(y) * sin(z)", "2 * sin(x) * sin(y) * cos(z)"]
_DU = [
    ["cos(x) * cos(y) * cos(z)", "-sin(x) * sin(y) * cos(z)", "-sin(x) * cos(y) * sin(z)"],
    ["sin(x) * sin(y) * cos(z)", "-cos(x) * cos(y) * cos(z)", "cos(x) * sin(y) * sin(z)"],
    ["0", "0", "0"],
]
_DO = [
    ["sin(x) * sin(y) * sin(z)", "-cos(x) * cos(y) * sin(z)", "-cos(x) * sin(y) * cos(z)"],
    ["-cos(x) * cos(y) * sin(z)", "sin(x) * sin(y) * sin(z)", "-sin(x) * cos(y) * cos(z)"],
    ["2 * cos(x) * sin(y) * cos(z)", "2 * sin(x) * cos(y) * cos(z)", "-2 * sin(x) * sin(y) * sin(z)"],
]


def _taylor_green(s, n: int) -> SpectralField:
    g = Grid(n, n, n)
    x, y, z = (F.col(f"i{a}") * g.spacing(a) for a in "xyz")
    at = G.delta(s, g, 0)
    u = RealField(at.df.select(*POINT, (F.sin(x) * F.cos(y) * F.cos(z)).alias("v0"), (-F.cos(x) * F.sin(y) * F.cos(z)).alias("v1"), F.lit(0.0).alias("v2")), g, 3)
    return S.curl(T.normalize(T.dft(u)))


_STRETCH = [" + ".join(f"({_O[j]}) * ({_DU[c][j]}) - ({_U[j]}) * ({_DO[c][j]})" for j in range(3)) for c in range(3)]
query("w1_nonlinear", f"SELECT CAST(0 AS BIGINT) AS snapshot, iz, iy, ix, {', '.join(r(x, f'v{c}') for c, x in enumerate(_STRETCH))} FROM {points_sql(16)}")(
    lambda s, d: rounded(T.ift(W.nonlinear(_taylor_green(s, 16), None)).df, POINT, ["v0", "v1", "v2"])
)


def _decaying_run(s, d) -> DataFrame:
    """Two steps of an ABC flow, which only decays, with particles in it: moments of the velocity."""
    kept: list = []
    flow = W.Flow(viscosity=0.1, dt=0.05, forcing={"kind": "none"})
    W.run(G.abc_modes(s, _GRID, 0.937, 0.713, 0.519), flow, 2, particles=G.tracers(s, 50), every_stat=2, on_stats=lambda k, w, p: kept.append(A.moments(T.ift(S.invert_curl(w))).withColumn("iteration", F.lit(k))))
    return rounded(kept[0].unionByName(kept[1]), ["iteration", "component"], ["min", *[f"m{n}" for n in range(1, 9)], "max"])


# No moment of these amplitudes lies halfway between two rounded ones.
_ODD = {"a": "(0.937 * sin(z) + 0.519 * cos(y))", "b": "(0.713 * sin(x) + 0.937 * cos(z))", "d": "(0.519 * sin(y) + 0.713 * cos(x))"}
_FLOWS = f"flow AS (SELECT CAST(k AS INTEGER) AS iteration, {', '.join(f'{e} * exp(-0.1 * 0.05 * k) AS {n}' for n, e in _ODD.items())} FROM {points_sql(8)}, (SELECT unnest([0, 2]) AS k))"
_PARTS = "parts AS (SELECT iteration, component, CASE component WHEN 'x' THEN a WHEN 'y' THEN b WHEN 'z' THEN d ELSE sqrt(a * a + b * b + d * d) END AS v FROM flow, (SELECT unnest(['x', 'y', 'z', 'm']) AS component))"
query("w6_run_with_particles", f"WITH {_FLOWS}, {_PARTS} SELECT iteration, component, {statistics.moment_sql('v')} FROM parts GROUP BY iteration, component")(_decaying_run)


def _frozen(s, d) -> DataFrame:
    w, _, _ = W.run(_abc(s), W.Flow(frozen=True), 2)
    return rounded(T.ift(S.invert_curl(w)).df, POINT, ["v0", "v1", "v2"])


query("w8_frozen", motion.SQL["g8_abc_flow"])(_frozen)


def _cadence(s, d) -> DataFrame:
    """At which iterations a run has statistics and output, whole and with a stop."""
    rows: list = []
    for name, stop in (("whole", None), ("stopped", lambda: sum(x[:2] == ("stopped", "statistics") for x in rows) >= 2)):
        note = lambda what, name=name: lambda k, w, p: rows.append((name, what, k))
        _, _, last = W.run(_abc(s), W.Flow(frozen=True), 12, every_stat=4, every_out=6, on_stats=note("statistics"), on_output=note("output"), stop=stop)
        rows.append((name, "last", last))
    return s.createDataFrame(rows, "run string, what string, iteration int")


query(
    "w9_cadence",
    """SELECT * FROM (VALUES ('whole', 'statistics', 0), ('whole', 'statistics', 4), ('whole', 'statistics', 8), ('whole', 'statistics', 12), ('whole', 'output', 0), ('whole', 'output', 6),
    ('whole', 'output', 12), ('whole', 'last', 12), ('stopped', 'statistics', 0), ('stopped', 'output', 0), ('stopped', 'statistics', 4), ('stopped', 'statistics', 5), ('stopped', 'output', 5), ('stopped', 'last', 5)) t(run, what, iteration)""",
)(_cadence)


class _Abc(jobs.Simulation):
    """A run from an ABC flow, with checkpoints alone."""

    def initial(self) -> SpectralField:
        return _abc(self.spark)

    def statistics(self, iteration: int, w: SpectralField, particles: DataFrame | None) -> None:
        pass


def _restarted(s, d) -> DataFrame:
    """Two runs in one folder: the second goes on where the first ended."""
    path = new_path(s, "restart")
    p = jobs.Parameters(n=8, frozen=True, niter_todo=2, niter_out=2, niter_stat=2)
    ends = [_Abc(s, path, p).run() for _ in range(2)]
    stored = io.Checkpoints(s, f"{path}/checkpoints", p.grid).union()
    power = sum((F.col(f"{q}{k}") * F.col(f"{q}{k}") for q in ("re", "im") for k in range(3)), F.lit(0.0))
    found = stored.groupBy(F.col("snapshot").cast("long").alias("snapshot")).agg(F.sum(power).alias("power"))
    return rounded(found.withColumn("last", F.lit(ends[-1]).cast("long")), ["snapshot", "last"], ["power"])


# Half of the spectrum: modes of kx = 0 stand in both signs, those along x in one.
query("w10_restart", f"SELECT CAST(k AS BIGINT) AS snapshot, CAST(4 AS BIGINT) AS last, {r('4 * 0.25 * 1.0 + 4 * 0.25 * 0.25 + 2 * 0.25 * 0.49', 'power')} FROM (SELECT unnest([0, 2, 4]) AS k)")(_restarted)

# The gradient of an ABC flow and its invariants by the traces' definitions.
_G = [["0", "-0.5 * sin(y)", "cos(z)"], ["0.7 * cos(x)", "0", "-sin(z)"], ["-0.7 * sin(x)", "0.5 * cos(y)", "0"]]
_I3 = range(3)
_TR = " + ".join(f"power((({_G[i][j]}) + ({_G[j][i]})) / 2, 2)" for i in _I3 for j in _I3)
_Q = "-(" + " + ".join(f"({_G[i][j]}) * ({_G[j][i]})" for i in _I3 for j in _I3) + ") / 2"
_R = "-(" + " + ".join(f"({_G[i][j]}) * ({_G[j][k]}) * ({_G[k][i]})" for i in _I3 for j in _I3 for k in _I3) + ") / 3"
_INV = f"inv AS (SELECT iz, iy, ix, {_TR} AS tr, {_Q} AS q, {_R} AS w FROM {points_sql(8)})"
query("a8_gradient_statistics", f"WITH {_INV}, long AS (SELECT quantity, CASE quantity WHEN 'TrS2' THEN tr WHEN 'Q' THEN q ELSE w END AS v FROM inv, (SELECT unnest(['TrS2', 'Q', 'R']) AS quantity)) SELECT CAST(0 AS BIGINT) AS snapshot, quantity, {statistics.moment_sql('v')} FROM long GROUP BY quantity")(
    lambda s, d: rounded(A.gradient_statistics(_abc(s), 8, (1.0, 1.0, 1.0))["invariants"], ["snapshot", "quantity"], ["min", *[f"m{n}" for n in range(1, 9)], "max"])
)
# Seven bins: no invariant that is nought by symmetry lies on an edge.
_BIN = lambda v, lim: f"CAST(floor(({v} + {lim}) / (2 * {lim} / 7)) AS INTEGER)"
query("a8_qr_histogram", f"WITH {_INV}, b AS (SELECT {_BIN('q', 0.83)} AS bin1, {_BIN('w', 0.57)} AS bin2 FROM inv) SELECT CAST(0 AS BIGINT) AS snapshot, 'Q' AS comp1, 'R' AS comp2, bin1, bin2, count(*) AS cnt FROM b WHERE bin1 BETWEEN 0 AND 6 AND bin2 BETWEEN 0 AND 6 GROUP BY bin1, bin2")(
    lambda s, d: A.gradient_statistics(_abc(s), 7, (1.0, 0.83, 0.57))["QR"]
)
query("d9_mean_trs2", f"WITH {_INV} SELECT CAST(0 AS BIGINT) AS snapshot, {r('avg(tr)', 'mean_trS2')} FROM inv")(lambda s, d: rounded(D.mean_tr_s2(A.gradient_statistics(_abc(s), 8, (1.0, 1.0, 1.0))["invariants"]), ["snapshot"], ["mean_trS2"]))


def _named(s, values: dict[str, float]) -> DataFrame:
    return rounded(s.createDataFrame(list(values.items()), "name string, value double"), ["name"], ["value"])


query("d11_estimate", f"SELECT name, {r('value', 'value')} FROM (VALUES ('nu', power(1.5 / 288, 4.0 / 3)), ('dt', 0.4 / 288), ('famplitude', 0.45)) t(name, value)")(lambda s, d: _named(s, D.estimate_parameters(288, 0.75, 0.4)))
query("d12_qr_bounds", f"SELECT name, {r('value', 'value')} FROM (VALUES ('TrS2', power(16 / 1.5, 4) * power(0.1, 2)), ('Q', power(16 / 1.5, 4) * power(0.1, 2)), ('R', 0.4 * power(power(16 / 1.5, 4) * power(0.1, 2), 1.5))) t(name, value)")(lambda s, d: _named(s, D.qr_bounds(32, 1.5, 0.1)))

# All statistics of a field at once: those of the single operators.
query("a3_stats_moments", statistics.SQL["a1_moments"])(lambda s, d: rounded(A.field_stats(V.vec3d(s, d), 0.4, 16)["moments"], ["snapshot", "component"], ["min", *[f"m{n}" for n in range(1, 9)], "max"]))
query("a3_stats_histogram", statistics.SQL["a2_histogram"].replace("16 / 0.8", f"16 / {0.4 * math.sqrt(3)!r}"))(lambda s, d: A.field_stats(V.vec3d(s, d), 0.4, 16)["histogram"])
query("a3_stats_spectrum", statistics.SQL["a4_cospectrum"])(lambda s, d: rounded(A.field_stats(V.vec3d(s, d), 0.4, 16)["spectrum"], ["snapshot", "shell", "i", "j"], ["value"]))

_VOUT = motion.SQL["s9_binary_to_table"]


def _grown(s, d) -> DataFrame:
    """A series written in two parts, odd snapshots first."""
    path, v = new_path(s, "series"), V.vec3d(s, d)
    for odd in (1, 0):
        io.write_field(v.of_snapshots(F.col("snapshot") % 2 == odd), path, "velocity")
    return rounded(io.read_field(s, path, "velocity", V.CUBE, "real", components=3).df, POINT, ["v0", "v1", "v2"])


query("s2_series", _VOUT)(_grown)


def _quantities(s, d) -> DataFrame:
    out = None
    for name, df in jobs.convert(_abc(s), ["enstrophy", "TrS2", "pressure"]).items():
        part = df.select(F.lit(name).alias("quantity"), *POINT, "v0")
        out = part if out is None else out.unionByName(part)
    return rounded(out, ["quantity", *POINT], ["v0"])


# Of a flow that is its own curl, enstrophy is the kinetic energy, and pressure its opposite about the mean.
_E = f"(power({_ABC['a']}, 2) + power({_ABC['b']}, 2) + power({_ABC['d']}, 2)) / 2"
query(
    "s11_convert",
    f"""SELECT quantity, CAST(0 AS BIGINT) AS snapshot, iz, iy, ix, {r(f"CASE quantity WHEN 'enstrophy' THEN {_E} WHEN 'TrS2' THEN {_TR} ELSE (1 + 0.49 + 0.25) / 2 - {_E} END", 'v0')}
    FROM {points_sql(8)}, (SELECT unnest(['enstrophy', 'TrS2', 'pressure']) AS quantity)""",
)(_quantities)


def _native_modes(s, d) -> DataFrame:
    """A complex field as native files and back."""
    path = new_path(s, "native-modes")
    name = lambda k: f"{path}-files/{io.binary_name('run', 'c', 'velocity', k)}"
    files = {k: name(k) for k in io.write_binary(cube(s, d), name)}
    return out3(io.read_binaries(s, files, V.CUBE, 3, space="complex"))


query("s12_complex_binary", spectra.SQL["t3_normalize"])(_native_modes)


def _complex_stored(s, d) -> DataFrame:
    path = new_path(s, "modes")
    io.write_field(cube(s, d), path, "velocity")
    return out3(io.read_field(s, path, "velocity", V.CUBE, "complex", components=3))


query("s13_read_complex", spectra.SQL["t3_normalize"])(_complex_stored)


def _particles_stored(s, d) -> DataFrame:
    path = new_path(s, "particles")
    rows = V.orders3(s, d).select((F.col("particle") % 2).alias("species"), "particle", "x", "y", "z")
    for step in (0, 5):
        io.write_particles(rows.withColumn("step", F.lit(step).cast("long")).withColumn("x", F.col("x") + step), path)
    return rounded(io.read_particles(s, path, 5).withColumn("species", F.col("species").cast("long")), ["species", "particle", "step"], ["x", "y", "z"])


query("s15_particles", f"WITH {V.PTS3} SELECT particle % 2 AS species, particle, CAST(5 AS BIGINT) AS step, {r('x + 5', 'x')}, {r('y', 'y')}, {r('z', 'z')} FROM pts3")(_particles_stored)


def _shells_stored(s, d) -> DataFrame:
    path = new_path(s, "shells")
    io.store_shells(Grid(64), s, path)
    return rounded(s.read.parquet(path), ["shell", "nshell"], ["kshell", "kM", "dk"])


query("s21_shells", f"SELECT *, 31.0 AS kM, 1.0 AS dk FROM ({spectra.SQL['k1_shells']})")(_shells_stored)


def _spectra_stored(s, d) -> DataFrame:
    path, found = new_path(s, "spectra"), A.cospectrum(cube(s, d))
    for odd in (0, 1):
        io.append_spectrum(found.filter(F.col("snapshot") % 2 == odd), path)
    return rounded(s.read.parquet(path), ["snapshot", "shell", "i", "j"], ["value"])


query("s23_spectrum", statistics.SQL["a4_cospectrum"])(_spectra_stored)
query("p8_redistribute", f"WITH {V.PTS3} SELECT particle, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} FROM pts3")(lambda s, d: rounded(P.redistribute(V.orders3(s, d), V.CUBE, 8), ["particle"], ["x", "y", "z"]))


def _hermitian(s, d) -> DataFrame:
    """What a random field breaks of its symmetry, has in its mean and beyond a third of the grid: nothing."""
    f = G.random_scalar(s, Grid(16, 16, 16)).df
    partner = f.filter("kx = 0").select((-F.col("ky")).alias("ky"), (-F.col("kz")).alias("kz"), F.col("re0").alias("pr"), F.col("im0").alias("pi"))
    apart = f.filter("kx = 0").join(partner, ["ky", "kz"]).agg(F.max(F.abs(F.col("re0") - F.col("pr")) + F.abs(F.col("im0") + F.col("pi"))).alias("value"))
    power = F.col("re0") * F.col("re0") + F.col("im0") * F.col("im0")
    k2 = sum((F.col(k) * F.col(k) for k in MODE[1:]), F.lit(0))
    outside = f.agg(F.sum(F.when((k2 == 0) | (k2 * 9 > 256), power).otherwise(0.0)).alias("value"))
    return rounded(apart.withColumn("name", F.lit("asymmetry")).unionByName(outside.withColumn("name", F.lit("outside"))), ["name"], ["value"])


query("g1_random_symmetry", "SELECT * FROM (VALUES ('asymmetry', 0.0), ('outside', 0.0)) t(name, value)")(_hermitian)


def _cloud_reach(s, d) -> DataFrame:
    """How many members each centre has, and how many of them stand within the cloud's half width."""
    near = F.greatest(*[F.abs(F.col(f"c.{a}") - F.col(f"o.{a}")) for a in "xyz"]) <= 0.1 + 1e-9
    met = G.random_cloud(V.orders3(s, d), 4, 0.1).alias("c").join(V.orders3(s, d).alias("o"), F.col("c.centre") == F.col("o.particle"))
    return met.groupBy("centre").agg(F.count("*").alias("members"), F.count_if(near).alias("near"))


query("g6_random_cloud_reach", "SELECT o_orderkey AS centre, CAST(4 AS BIGINT) AS members, CAST(4 AS BIGINT) AS near FROM orders")(_cloud_reach)
query("g5_tracers_box", "SELECT CAST(1000 AS BIGINT) AS n, CAST(1000 AS BIGINT) AS inside, CAST(1000 AS BIGINT) AS places")(
    lambda s, d: G.tracers(s, 1000).agg(F.count("*").alias("n"), F.count_if((F.least("x", "y", "z") >= 0) & (F.greatest("x", "y", "z") < 2 * math.pi)).alias("inside"), F.countDistinct("x", "y", "z").alias("places"))
)
