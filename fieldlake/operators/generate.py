"""Generated fields and particles: ranges and seeded random columns, never driver-side arrays."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.functions.grid import Grid
from fieldlake.model import MODE, POINT, RealField, SpectralField
from fieldlake.operators.spectral import resize, symmetrize


def _uniform(seed: int, *what):
    """A number in (0, 1) that depends on the mode alone, so that recomputing gives the same field."""
    h = F.xxhash64(F.lit(seed), *what)
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)


def _normal(seed: int, *what):
    return F.sqrt(-2 * F.log(_uniform(seed, F.lit("r"), *what))) * F.cos(2 * math.pi * _uniform(seed, F.lit("a"), *what))


def random_scalar(spark: SparkSession, grid: Grid, *, slope: float = 1.5, amplitude: float = 0.5, seed: int = 7547, components: int = 1) -> SpectralField:
    """Gaussian amplitudes over k^slope; no mean, Hermitian on kx = 0, nothing beyond a third of the grid."""
    k = F.sqrt(F.pow("kx", F.lit(2)) + F.pow("ky", F.lit(2)) + F.pow("kz", F.lit(2)))
    modes = grid.modes(spark).withColumn("snapshot", F.lit(0).cast("long")).withColumn("k", k)
    scale = F.when((F.col("k") > 0) & (F.col("k") <= min(grid.nx, grid.ny, grid.nz) / 3), amplitude / F.pow("k", F.lit(slope))).otherwise(0.0)
    at = [F.col("kx"), F.col("ky"), F.col("kz")]
    values = [(_normal(seed, F.lit(2 * c + p), *at) * scale).alias(f"{part}{c}") for c in range(components) for p, part in enumerate(("re", "im"))]
    return symmetrize(SpectralField(modes.select(*MODE, *values), grid, components))


def uniform_sheet(spark: SparkSession, grid: Grid, amplitude: float = 0.5) -> SpectralField:
    """A constant amplitude in the plane ky = 0."""
    modes = grid.modes(spark).withColumn("snapshot", F.lit(0).cast("long"))
    return SpectralField(modes.select(*MODE, F.when(F.col("ky") == 0, F.lit(amplitude)).otherwise(0.0).alias("re0"), F.lit(0.0).alias("im0")), grid, 1)


def random_vector(spark: SparkSession, grid: Grid, *, slope: float = 1.0, amplitude: float = 0.05, seed: int = 7547) -> SpectralField:
    """Three random components at half resolution, padded to the grid."""
    half = Grid(grid.nx // 2, grid.ny // 2, grid.nz // 2, grid.dkx, grid.dky, grid.dkz, grid.dealias)
    return resize(random_scalar(spark, half, slope=slope, amplitude=amplitude, seed=seed, components=3), grid)


def randomize_phases(f: SpectralField, seed: int = 1) -> SpectralField:
    """Every mode turned by a random phase; on kx = 0 partners turn in opposite directions."""
    lead = (F.col("ky") > 0) | (F.col("ky") == 0) & (F.col("kz") > 0)
    own = 2 * math.pi * _uniform(seed, F.col("kx"), F.col("ky"), F.col("kz"))
    partner = -2 * math.pi * _uniform(seed, F.col("kx"), -F.col("ky"), -F.col("kz"))
    zero = (F.col("kx") == 0) & (F.col("ky") == 0) & (F.col("kz") == 0)
    phi = F.when(zero, 0.0).when((F.col("kx") > 0) | lead, own).otherwise(partner)
    return f.map(*[(re * F.cos(phi) - im * F.sin(phi), re * F.sin(phi) + im * F.cos(phi)) for re, im in f.pairs()])


def tracers(spark: SparkSession, n: int, *, seed: int = 2, species: int = 0) -> DataFrame:
    """``n`` particles, uniform in the box of length 2 pi."""
    position = [(2 * math.pi * _uniform(seed, F.lit(a), F.col("id"))).alias(a) for a in "xyz"]
    return spark.range(n).select(F.lit(species).alias("species"), F.col("id").alias("particle"), F.lit(0).cast("long").alias("step"), *position, F.expr("cast(array() as array<struct<x:double,y:double,z:double>>)").alias("rhs"))


def random_cloud(centres: DataFrame, n: int, radius: float, seed: int = 3) -> DataFrame:
    """``n`` particles in a cube around each centre (particle, x, y, z)."""
    spread = centres.select(F.col("particle").alias("centre"), *"xyz", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("member"))
    return spread.select("centre", "member", *[(F.col(a) + radius * (2 * _uniform(seed, F.lit(a), F.col("centre"), F.col("member")) - 1)).alias(a) for a in "xyz"])


def regular_cloud(centres: DataFrame, n: int, width: float) -> DataFrame:
    """An n^3 lattice of the given width around each centre; ``n`` of 1 is the centre."""
    at = lambda k: (k / (n - 1) - 0.5) * width if n > 1 else k * 0.0
    spread = centres.select(F.col("particle").alias("centre"), *"xyz", F.explode(F.sequence(F.lit(0), F.lit(n**3 - 1))).alias("member"))
    index = {"x": F.col("member") % n, "y": F.floor(F.col("member") / n) % n, "z": F.floor(F.col("member") / (n * n))}
    return spread.select("centre", "member", *[(F.col(a) + at(index[a].cast("double"))).alias(a) for a in "xyz"])


def lattice(spark: SparkSession, n: int, length: float = 2 * math.pi) -> DataFrame:
    """An n x n lattice on z = 0."""
    p = spark.range(n * n)
    return p.select(F.col("id").alias("particle"), (F.col("id") % n * (length / n)).alias("x"), (F.floor(F.col("id") / n) * (length / n)).alias("y"), F.lit(0.0).alias("z"))


def _grid_points(spark: SparkSession, grid: Grid) -> DataFrame:
    p = spark.range(grid.points).select(F.col("id"))
    return p.select(F.lit(0).cast("long").alias("snapshot"), F.floor(F.col("id") / (grid.nx * grid.ny)).cast("int").alias("iz"), (F.floor(F.col("id") / grid.nx) % grid.ny).cast("int").alias("iy"), (F.col("id") % grid.nx).cast("int").alias("ix"))


def delta(spark: SparkSession, grid: Grid, dimension: int) -> RealField:
    """Unit integral on a point (dimension 0), a line along x (1) or a sheet of constant z (2)."""
    if dimension not in (0, 1, 2):
        raise ValueError("dimension is 0, 1 or 2")
    axes = "xyz"[dimension:]
    here, height = F.lit(True), 1.0
    for a in axes:
        here, height = here & (F.col(f"i{a}") == 0), height / grid.spacing(a)
    return RealField(_grid_points(spark, grid).select(*POINT, F.when(here, F.lit(height)).otherwise(0.0).alias("v0")), grid, 1)


def abc_flow(spark: SparkSession, grid: Grid, a: float = 1.0, b: float = 1.0, c: float = 1.0) -> RealField:
    """The flow (A sin z + C cos y, B sin x + A cos z, C sin y + B cos x)."""
    x, y, z = (F.col(f"i{s}") * grid.spacing(s) for s in "xyz")
    u = [a * F.sin(z) + c * F.cos(y), b * F.sin(x) + a * F.cos(z), c * F.sin(y) + b * F.cos(x)]
    return RealField(_grid_points(spark, grid).select(*POINT, *[v.alias(f"v{k}") for k, v in enumerate(u)]), grid, 3)


def abc_modes(spark: SparkSession, grid: Grid, a: float = 1.0, b: float = 1.0, c: float = 1.0) -> SpectralField:
    """The same flow by its amplitudes."""
    sine, cosine = (F.lit(0.0), -0.5), (F.lit(0.5), 0.0)
    parts = {(0, 0, 1): [(0, a, sine), (1, a, cosine)], (0, 1, 0): [(2, c, sine), (0, c, cosine)], (1, 0, 0): [(1, b, sine), (2, b, cosine)]}
    re, im = [F.lit(0.0)] * 3, [F.lit(0.0)] * 3
    for (kx, ky, kz), terms in parts.items():
        for comp, amp, (r, i) in terms:
            for sign in (1, -1):
                here = (F.col("kx") == kx * sign) & (F.col("ky") == ky * sign) & (F.col("kz") == kz * sign)
                re[comp] = F.when(here, r * amp).otherwise(re[comp])
                im[comp] = F.when(here, F.lit(i * amp * sign)).otherwise(im[comp])
    modes = grid.modes(spark).withColumn("snapshot", F.lit(0).cast("long"))
    return SpectralField(modes.select(*MODE, *[x.alias(f"{p}{k}") for k in range(3) for p, x in (("re", re[k]), ("im", im[k]))]), grid, 3)
