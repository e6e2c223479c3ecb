"""Projections, filters and calculus on spectral fields: all are expressions on each mode."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldlake.functions.grid import Grid
from fieldlake.model import MODE, RealField, SpectralField, components_of, need
from fieldlake.operators.transform import dft

FILTERS = ("sharp_Fourier_sphere", "Gauss", "ball")


def _wave(g: Grid):
    return [g.wave(a) for a in "xyz"]


def low_pass(f: SpectralField, kmax: float) -> SpectralField:
    """Zero from kmax on."""
    return f.keep(f.grid.k2 < kmax**2)


def low_pass_sparse(f: SpectralField, kmax: float) -> SpectralField:
    """The same with the zero modes left out, so that the filter reaches the scan."""
    return f.with_df(f.df.filter(f.grid.k2 < kmax**2))


def gauss_filter(f: SpectralField, sigma: float) -> SpectralField:
    return f.scale(F.exp(-0.5 * sigma * sigma * f.grid.k2))


def ball_filter(f: SpectralField, length: float) -> SpectralField:
    """The transform of a ball of diameter ``length``; the zero mode stays."""
    x = F.sqrt(f.grid.k2) * (length / 2)
    factor = F.when(f.grid.k2 > 0, 3 * (F.sin(x) - x * F.cos(x)) / (x * x * x)).otherwise(1.0)
    return f.scale(factor)


def filter_at(f: SpectralField, wavenumber: float, kind: str) -> SpectralField:
    """By wavenumber: sharp at it, Gauss of sigma = pi / wavenumber, ball of length pi / wavenumber."""
    if kind not in FILTERS:
        raise ValueError(f"filters are {FILTERS}")
    if kind == FILTERS[0]:
        return low_pass(f, wavenumber)
    return (gauss_filter if kind == "Gauss" else ball_filter)(f, math.pi / wavenumber)


def filter_length(f: SpectralField, length: float, kind: str) -> SpectralField:
    """By length, the three kinds calibrated against each other."""
    if kind not in FILTERS:
        raise ValueError(f"filters are {FILTERS}")
    if kind == FILTERS[0]:
        return low_pass(f, 2.8 / length)
    return gauss_filter(f, 0.23 * length) if kind == "Gauss" else ball_filter(f, length)


def dealias(f: SpectralField) -> SpectralField:
    """By the grid's rule: a smooth cut-off of order 36, or a sharp one at km."""
    g = f.grid
    if g.dealias == "two_thirds":
        return low_pass(f, g.km)
    return f.scale(F.exp(-36.0 * F.pow(g.k2 / g.km**2, F.lit(18.0))))


def divergence_free(f: SpectralField) -> SpectralField:
    """a - k (k.a) / k^2; the zero mode becomes 0."""
    components_of(f, 3)
    return f.map(*solenoidal_pairs(f))


def solenoidal_pairs(f: SpectralField) -> list[tuple]:
    """The same as amplitudes, of the first three components."""
    k, k2, a = _wave(f.grid), f.grid.k2, f.pairs()
    along = [sum((k[c] * a[c][part] for c in range(1, 3)), k[0] * a[0][part]) / k2 for part in (0, 1)]
    return [tuple(F.when(k2 > 0, a[c][part] - k[c] * along[part]).otherwise(0.0) for part in (0, 1)) for c in range(3)]


def symmetrize(f: SpectralField) -> SpectralField:
    """On kx = 0 the modes of negative ky (of negative kz where ky = 0) become their partners' conjugates.

    The zero mode becomes real; the middle rows of even axes have no partner and stay.
    """
    g = f.grid
    plane, rest = f.df.filter("kx = 0"), f.df.filter("kx <> 0")
    lead = (F.col("ky") > 0) | (F.col("ky") == 0) & (F.col("kz") > 0)
    inner = (F.abs("ky") * 2 < g.ny) & (F.abs("kz") * 2 < g.nz)
    partner = plane.filter(lead & inner).select("snapshot", (-F.col("ky")).alias("ky"), (-F.col("kz")).alias("kz"), "kx", *[F.col(v).alias("p" + v) for v in f.values])
    met = plane.join(partner, list(MODE), "left")
    zero = (F.col("ky") == 0) & (F.col("kz") == 0)
    out = []
    for c in range(f.components):
        out += [F.coalesce(f"pre{c}", f"re{c}").alias(f"re{c}"), F.when(zero, 0.0).otherwise(F.coalesce(-F.col(f"pim{c}"), f"im{c}")).alias(f"im{c}")]
    return f.with_df(met.select(*MODE, *out).unionByName(rest.select(*MODE, *f.values)))


def zero_mode(f: SpectralField, value: tuple[float, float] = (0.0, 0.0)) -> SpectralField:
    zero = (F.col("kx") == 0) & (F.col("ky") == 0) & (F.col("kz") == 0)
    return f.map(*[tuple(F.when(zero, F.lit(x)).otherwise(p) for x, p in zip(value, pair)) for pair in f.pairs()])


def gradient(f: SpectralField) -> SpectralField:
    """i k_d a_c within km; the derivative's index comes first."""
    components_of(f, 1, 3)
    g = f.grid
    inside = g.k2 < g.km**2
    return f.map(*[(F.when(inside, -k * im).otherwise(0.0), F.when(inside, k * re).otherwise(0.0)) for k in _wave(g) for re, im in f.pairs()])


def cross_pairs(f: SpectralField, scale, inside) -> list[tuple]:
    """i k x a, times ``scale`` where ``inside``."""
    k, a = _wave(f.grid), f.pairs()
    out = []
    for c in range(3):
        d, e = (c + 1) % 3, (c + 2) % 3
        re = -(k[d] * a[e][1] - k[e] * a[d][1])
        im = k[d] * a[e][0] - k[e] * a[d][0]
        out.append(tuple(F.when(inside, x * scale).otherwise(0.0) for x in (re, im)))
    return out


def curl(f: SpectralField, symmetric: bool = True) -> SpectralField:
    """Vorticity from velocity, within km."""
    components_of(f, 3)
    out = f.map(*cross_pairs(f, F.lit(1.0), f.grid.k2 <= f.grid.km**2))
    return symmetrize(out) if symmetric else out


def invert_curl(f: SpectralField, symmetric: bool = True) -> SpectralField:
    """Velocity from vorticity, within km; no mean flow."""
    components_of(f, 3)
    out = f.map(*velocity_pairs(f))
    return symmetrize(out) if symmetric else out


def velocity_pairs(f: SpectralField) -> list[tuple]:
    """The velocity's amplitudes by those of the vorticity; of a Hermitian field they are Hermitian."""
    k2 = f.grid.k2
    return cross_pairs(f, 1.0 / k2, (k2 > 0) & (k2 <= f.grid.km**2))


PRODUCTS = ((0, 0), (1, 1), (2, 2), (0, 1), (1, 2), (2, 0))


def products(u: RealField) -> SpectralField:
    """The six products of a velocity's components, transformed, normalised and dealiased."""
    need(u, RealField, "products")
    components_of(u, 3)
    n = float(u.grid.points)
    return dealias(dft(u.map(*[F.col(f"v{i}") * F.col(f"v{j}") / n for i, j in PRODUCTS])))


def pressure(u: RealField, uu: SpectralField | None = None) -> SpectralField:
    """-k_i k_j (u_i u_j)^ / k^2 within km, for the real-space velocity."""
    uu = uu or products(u)
    k, g = _wave(u.grid), u.grid
    a = uu.pairs()
    inside = (g.k2 > 0) & (g.k2 <= g.km**2)
    out = []
    for part in (0, 1):
        s = sum(((1 if i == j else 2) * k[i] * k[j] * a[m][part] for m, (i, j) in enumerate(PRODUCTS) if m), k[0] * k[0] * a[0][part])
        out.append(F.when(inside, -s / g.k2).otherwise(0.0))
    return uu.map(tuple(out))


def linear_terms(u: SpectralField, viscosity: float, forcing: dict | None = None) -> SpectralField:
    """-nu k^2 u, with A u in the band of a linear forcing."""
    k2 = u.grid.k2
    rate = -viscosity * k2
    if forcing and forcing["kind"] == "linear":
        k = F.sqrt(k2)
        rate = rate + F.when((k >= forcing["k0"]) & (k <= forcing["k1"]), F.lit(float(forcing["amplitude"]))).otherwise(0.0)
    return u.scale(rate)


def lagrangian_acceleration(u: SpectralField, p: SpectralField, viscosity: float, forcing: dict | None = None) -> SpectralField:
    """Linear terms - i k p, within km."""
    components_of(u, 3)
    lin = linear_terms(u, viscosity, forcing)
    met = lin.with_df(lin.join(p, "p"))
    k, inside = _wave(u.grid), u.grid.k2 <= u.grid.km**2
    return met.map(*[(F.when(inside, re + k[c] * F.col("pim0")).otherwise(0.0), F.when(inside, im - k[c] * F.col("pre0")).otherwise(0.0)) for c, (re, im) in enumerate(met.pairs())])


def eulerian_acceleration(u: SpectralField, uu: SpectralField, viscosity: float, forcing: dict | None = None) -> SpectralField:
    """Linear terms - i k_j (u_i u_j)^ within km, without mean and divergence."""
    lin = linear_terms(u, viscosity, forcing)
    met = lin.with_df(lin.join(uu, "p"))
    k, inside = _wave(u.grid), u.grid.k2 <= u.grid.km**2
    number = {pair: m for m, pair in enumerate(PRODUCTS)} | {(j, i): m for m, (i, j) in enumerate(PRODUCTS)}
    out = []
    for c, (re, im) in enumerate(met.pairs()):
        r = sum((k[j] * F.col(f"pim{number[c, j]}") for j in (1, 2)), k[0] * F.col(f"pim{number[c, 0]}"))
        i = sum((k[j] * F.col(f"pre{number[c, j]}") for j in (1, 2)), k[0] * F.col(f"pre{number[c, 0]}"))
        out.append((F.when(inside, re + r).otherwise(0.0), F.when(inside, im - i).otherwise(0.0)))
    return divergence_free(met.map(*out))


def add_forcing(dst: SpectralField, vorticity: SpectralField, factor: float, forcing: dict | None) -> SpectralField:
    """``dst`` with the forcing of the vorticity equation: none, Kolmogorov (mode, amplitude) or linear (k0, k1, amplitude)."""
    if (forcing or {}).get("kind") == "linear":
        dst = dst.with_df(dst.join(vorticity, "w"))
    return dst.map(*forced_pairs(dst, [(F.col(f"wre{c}"), F.col(f"wim{c}")) for c in range(3)], factor, forcing))


def forced_pairs(dst: SpectralField, vorticity: list[tuple], factor: float, forcing: dict | None) -> list[tuple]:
    """The amplitudes of ``dst`` with the forcing, by those of a vorticity that stand in the same rows."""
    kind, pairs = (forcing or {"kind": "none"})["kind"], dst.pairs()
    if kind == "none":
        return pairs
    a = float(forcing["amplitude"])
    if kind == "Kolmogorov":
        here = (F.col("kx") == 0) & (F.col("kz") == 0) & (F.abs("ky") == int(forcing["mode"]))
        pairs[2] = (F.when(here, pairs[2][0] - a * factor / 2).otherwise(pairs[2][0]), pairs[2][1])
        return pairs
    if kind == "linear":
        k = F.sqrt(dst.grid.k2)
        band = F.when((k >= forcing["k0"]) & (k <= forcing["k1"]), F.lit(a * factor)).otherwise(0.0)
        return [(re + band * wre, im + band * wim) for (re, im), (wre, wim) in zip(pairs, vorticity)]
    raise ValueError("forcing is none, Kolmogorov or linear")


def resize(f: SpectralField, grid: Grid) -> SpectralField:
    """The same amplitudes on another grid: modes that both can hold, zero elsewhere."""
    inside = (F.col("kx") <= grid.nx // 2) & F.col("ky").between(*grid.signed(grid.ny)) & F.col("kz").between(*grid.signed(grid.nz))
    kept = f.df.filter(inside)
    # Every mode of the other grid, one axis after another: a row never holds more than an axis.
    along = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi)))
    dense = f.df.select("snapshot").distinct().select("snapshot", along(*grid.signed(grid.ny)).alias("ky")).repartition("snapshot", "ky")
    dense = dense.select("snapshot", "ky", along(*grid.signed(grid.nz)).alias("kz")).select("snapshot", "ky", "kz", along(0, grid.nx // 2).alias("kx"))
    out = dense.join(kept, list(MODE), "left").select(*MODE, *[F.coalesce(v, F.lit(0.0)).alias(v) for v in f.values])
    return SpectralField(out, grid, f.components)
