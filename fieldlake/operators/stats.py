"""Moments, histograms, spectra and pointwise maps.  Every statistic is one partial and final aggregate."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.functions.grid import nxmodes
from fieldlake.model import POINT, RealField, SpectralField, components_of, need
from fieldlake.operators.spectral import gradient
from fieldlake.operators.transform import dft, ift, normalize

LETTERS = "xyz"


def names_of(components: int) -> list[str]:
    if components == 9:
        return [a + b for a in LETTERS for b in LETTERS]
    return list(LETTERS) if components == 3 else ["s"]


def magnitude(prefix: str = "v"):
    return F.sqrt(sum((F.col(f"{prefix}{c}") * F.col(f"{prefix}{c}") for c in (1, 2)), F.col(f"{prefix}0") * F.col(f"{prefix}0")))


def long_form(f: RealField) -> DataFrame:
    """snapshot, component, v: components, and the magnitude m of vectors, as rows."""
    items = [F.struct(F.lit(n).alias("component"), F.col(v).alias("v")) for n, v in zip(names_of(f.components), f.values)]
    if f.components == 3:
        items.append(F.struct(F.lit("m").alias("component"), magnitude().alias("v")))
    return f.df.select("snapshot", F.explode(F.array(*items)).alias("x")).select("snapshot", "x.*")


def moment_aggregates(v, compat: bool = False) -> list:
    """min, mean powers 1 to 8, max; ``compat`` lets min and max start from 0."""
    lo, hi = F.min(v), F.max(v)
    if compat:
        lo, hi = F.least(lo, F.lit(0.0)), F.greatest(hi, F.lit(0.0))
    powers, p = [], v
    for n in range(1, 9):
        powers.append(F.avg(p).alias(f"m{n}"))
        p = p * v
    return [lo.alias("min"), *powers, hi.alias("max")]


def moments(f: RealField, compat: bool = False) -> DataFrame:
    """snapshot, component, min, m1..m8, max."""
    need(f, RealField, "moments")
    return long_form(f).groupBy("snapshot", "component").agg(*moment_aggregates(F.col("v"), compat))


def value_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same of any numeric column by any keys."""
    return df.groupBy(*keys).agg(*moment_aggregates(F.col(value).cast("double")))


def bin_of(v, limit: float, bins: int, signed: bool = True):
    """Number of the bin on [-limit, limit], or of [0, limit] for magnitudes."""
    return F.floor((v + limit) / (2 * limit / bins)) if signed else F.floor(v * bins / limit)


def histogram(f: RealField, limits: list[float], bins: int, fill: bool = True) -> DataFrame:
    """snapshot, component, bin, cnt; what lies outside the limits isn't counted.

    ``limits``: one for each component, and one more for the magnitude of a vector.
    """
    kinds = names_of(f.components) + (["m"] if f.components == 3 else [])
    if len(limits) != len(kinds):
        raise ValueError(f"{len(kinds)} limits are needed")
    number = F.coalesce(*[F.when(F.col("component") == n, bin_of(F.col("v"), lim, bins, n != "m")) for n, lim in zip(kinds, limits)]).cast("int")
    inside = F.when(number.between(0, bins - 1), number).otherwise(-1)
    counted = long_form(f).groupBy("snapshot", "component", inside.alias("bin")).agg(F.count("*").alias("cnt"))
    if not fill:
        return counted.filter("bin >= 0")
    # The field is read once: its counts, at most one for each bin, make the row that the bins are read from.
    known = counted.groupBy("snapshot", "component").agg(F.map_from_entries(F.collect_list(F.struct("bin", "cnt"))).alias("known"))
    every = known.select("snapshot", "component", "known", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.select("snapshot", "component", "bin", F.coalesce(F.try_element_at("known", F.col("bin")), F.lit(0)).cast("long").alias("cnt"))


def joint_histogram(f1: RealField, f2: RealField, limit1: float, limit2: float, bins: int, signed: bool = False) -> DataFrame:
    """snapshot, comp1, comp2, bin1, bin2, cnt of two fields at the same points.

    Vectors: nine component pairs within limit / sqrt(3), and the magnitudes within the limit.
    Scalars: bins of limit / bins from 0, or with ``signed`` on both sides of 0.
    """
    if f1.components != f2.components:
        raise TypeError("both fields need the same components")
    components_of(f1, 1, 3)
    met = f1.join(f2, "w")
    side = math.sqrt(3)
    if f1.components == 1:
        items = [("s", "s", bin_of(F.col("v0"), limit1, bins, signed), bin_of(F.col("w0"), limit2, bins, signed))]
    else:
        items = [(a, b, bin_of(F.col(f"v{i}"), limit1 / side, bins), bin_of(F.col(f"w{j}"), limit2 / side, bins)) for i, a in enumerate(LETTERS) for j, b in enumerate(LETTERS)]
        items.append(("m", "m", bin_of(magnitude("v"), limit1, bins, False), bin_of(magnitude("w"), limit2, bins, False)))
    return _joint(met, ["snapshot"], items, bins)


def _joint(df: DataFrame, keys: list[str], items: list[tuple], bins: int) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(a).alias("comp1"), F.lit(b).alias("comp2"), x.cast("int").alias("bin1"), y.cast("int").alias("bin2")) for a, b, x, y in items])
    inside = F.filter(cells, lambda c: c["bin1"].between(0, bins - 1) & c["bin2"].between(0, bins - 1))
    return df.select(*keys, F.explode(inside).alias("c")).select(*keys, "c.*").groupBy(*keys, "comp1", "comp2", "bin1", "bin2").agg(F.count("*").alias("cnt"))


def joint_counts(df: DataFrame, keys: list[str], a: str, b: str, limit_a: float, limit_b: float, bins: int) -> DataFrame:
    """Joint histogram of two numeric columns by any keys, bins from 0."""
    return _joint(df, keys, [(a, b, bin_of(F.col(a), limit_a, bins, False), bin_of(F.col(b), limit_b, bins, False))], bins)


def cospectrum(a: SpectralField, b: SpectralField | None = None, k2exponent: float = 0.0) -> DataFrame:
    """snapshot, shell, i, j, value: sums of Re(a_i b_j*) over the shells within km, weighted by (k^2)^k2exponent."""
    need(a, SpectralField, "cospectrum")
    g = a.grid
    inside = g.k2 <= g.km**2
    if b is None:  # a field with itself needs no join
        df, other = a.df.filter(inside), ""
    else:
        df, other = a.with_df(a.df.filter(inside)).join(b.with_df(b.df.filter(inside)), "o"), "o"
    weight = nxmodes() * (F.pow(g.k2, F.lit(float(k2exponent))) if k2exponent else F.lit(1.0))
    n, m = a.components, (b or a).components
    sums = [F.sum(weight * (F.col(f"re{i}") * F.col(f"{other}re{j}") + F.col(f"im{i}") * F.col(f"{other}im{j}"))).alias(f"s{i}_{j}") for i in range(n) for j in range(m)]
    shells = df.withColumn("shell", g.shell).groupBy("snapshot", "shell").agg(*sums)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("value")) for i in range(n) for j in range(m)])
    return shells.select("snapshot", "shell", F.explode(cells).alias("c")).select("snapshot", "shell", "c.*")


def autocorrelation(a: SpectralField) -> DataFrame:
    """snapshot, value: the trace of the spectrum, summed over its shells."""
    return cospectrum(a).filter("i = j").groupBy("snapshot").agg(F.sum("value").alias("value"))


def field_stats(f, limit: float, bins: int) -> dict[str, DataFrame]:
    """Moments, histogram and spectrum of a field in either space."""
    real = f if isinstance(f, RealField) else ift(f)
    spectral = f if isinstance(f, SpectralField) else normalize(dft(f))
    limits = [limit] * f.components + ([limit * math.sqrt(3)] if f.components == 3 else [])
    return {"moments": moments(real), "histogram": histogram(real, limits, bins), "spectrum": cospectrum(spectral)}


def cross_product(u: RealField, w: RealField) -> RealField:
    """u x w at each point, divided by the number of points."""
    components_of(u, 3)
    return u.with_df(u.join(w, "w")).map(*_cross("v", "w", 0, u.grid.points))


def cross_product_within(both: RealField) -> RealField:
    """The same of the first three components and the last three of one field: no join."""
    components_of(both, 6)
    return both.map(*_cross("v", "v", 3, both.grid.points))


def _cross(a: str, b: str, first: int, points: int) -> list:
    at = lambda c: (F.col(f"{a}{(c + 1) % 3}"), F.col(f"{a}{(c + 2) % 3}"), F.col(f"{b}{first + (c + 1) % 3}"), F.col(f"{b}{first + (c + 2) % 3}"))
    return [(p * t - q * s) / float(points) for p, q, s, t in map(at, range(3))]


def increments(u: RealField, r: int) -> RealField:
    """u(x + r) - u(x) along x on the periodic grid: a self join on the shifted point."""
    moved = u.df.select("snapshot", "iz", "iy", F.pmod(F.col("ix") - r, F.lit(u.grid.nx)).cast("int").alias("ix"), *[F.col(v).alias("w" + v[1:]) for v in u.values])
    return u.with_df(u.df.join(moved, list(POINT))).map(*[F.col("w" + v[1:]) - F.col(v) for v in u.values])


def gradient_invariants(a: RealField) -> RealField:
    """TrS2, Q and R of a velocity gradient (nine components, derivative first)."""
    components_of(a, 9)
    m = [[F.col(f"v{3 * d + c}") for c in range(3)] for d in range(3)]
    add = lambda terms: functools.reduce(operator.add, terms)
    three = range(3)
    strain = [[(m[i][j] + m[j][i]) * 0.5 for j in three] for i in three]
    square = [[add(m[i][k] * m[k][j] for k in three) for j in three] for i in three]
    tr_s2 = add(strain[i][j] * strain[i][j] for i in three for j in three)
    q = add(square[i][i] for i in three) * -0.5
    r = add(square[i][j] * m[j][i] for i in three for j in three) / -3
    return a.map(tr_s2, q, r)


def gradient_statistics(u: SpectralField, bins: int, limits: tuple[float, float, float]) -> dict[str, DataFrame]:
    """Moments of the invariants and of the gradient's components, and the joint histogram of Q and R."""
    grad = ift(gradient(u))
    inv = gradient_invariants(grad)
    names = ("TrS2", "Q", "R")
    rows = inv.df.select("snapshot", F.explode(F.array(*[F.struct(F.lit(n).alias("quantity"), F.col(f"v{c}").alias("v")) for c, n in enumerate(names)])).alias("x")).select("snapshot", "x.*")
    qr = [("Q", "R", bin_of(F.col("v1"), limits[1], bins), bin_of(F.col("v2"), limits[2], bins))]
    return {"invariants": value_moments(rows, ["snapshot", "quantity"], "v"), "gradient": moments(grad), "QR": _joint(inv.df, ["snapshot"], qr, bins)}


def enstrophy(w: RealField) -> RealField:
    components_of(w, 3)
    return w.map(0.5 * (F.col("v0") * F.col("v0") + F.col("v1") * F.col("v1") + F.col("v2") * F.col("v2")))


kinetic_energy = enstrophy


def mean(f: RealField) -> DataFrame:
    """Grid means of all components by snapshot."""
    return f.df.groupBy("snapshot").agg(*[F.avg(v).alias(v) for v in f.values])


def time_average(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means over the snapshots."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def cut(u: RealField, iy: int) -> RealField:
    """Kinetic energy on the plane of one y."""
    return kinetic_energy(u.with_df(u.df.filter(F.col("iy") == iy)))


