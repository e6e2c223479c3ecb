"""Derived flow statistics from spectra, moments and shells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.functions.grid import Grid


def window(df: DataFrame, first: int, last: int) -> DataFrame:
    """Snapshots of an inclusive range; a partition filter where the table is partitioned by snapshot."""
    return df.filter(F.col("snapshot").between(first, last))


def shell_energy(spectrum: DataFrame) -> DataFrame:
    """snapshot, shell, energy: half the trace of the spectrum tensor (enstrophy for vorticity)."""
    return spectrum.filter("i = j").groupBy("snapshot", "shell").agg((F.sum("value") / 2).alias("energy"))


def times(moments: DataFrame, dt: float, every: int = 1) -> DataFrame:
    """snapshot, t, vel_max and renergy from the magnitude's moments."""
    return moments.filter("component = 'm'").select("snapshot", (F.col("snapshot") * (dt * every)).alias("t"), F.col("max").alias("vel_max"), (F.col("m2") / 2).alias("renergy"))


def per_time(energy: DataFrame, enstrophy: DataFrame, shells: DataFrame, grid: Grid, viscosity: float) -> DataFrame:
    """energy, enstrophy, Uint, Lint, diss, etaK, tauK, Re, lambda, Rlambda, kMeta and Tint of every snapshot.

    Shells without a mean wavenumber count for nothing in Lint.
    """
    e = energy.join(F.broadcast(shells.select("shell", "kshell")), "shell", "left")  # a row for each shell
    e = e.groupBy("snapshot").agg((F.sum("energy") * grid.dk).alias("energy"), F.sum(F.try_divide("energy", F.col("kshell"))).alias("ratio"))
    z = enstrophy.groupBy("snapshot").agg((F.sum("energy") * grid.dk).alias("enstrophy"))
    return quantities(e.join(z, "snapshot"), grid, viscosity)


def quantities(df: DataFrame, grid: Grid, viscosity: float) -> DataFrame:
    """The scales that follow from energy, enstrophy and the sum of E(k) / k (``ratio``)."""
    nu = float(viscosity)
    df = df.withColumn("Uint", F.sqrt(2 * F.col("energy") / 3))
    df = df.withColumn("Lint", F.try_divide(grid.dk * math.pi * F.col("ratio"), 2 * F.col("Uint") * F.col("Uint"))).drop("ratio")
    return scales(df, grid, nu)


def scales(df: DataFrame, grid: Grid, nu: float) -> DataFrame:
    """What follows from energy, enstrophy, Uint and Lint."""
    df = df.withColumn("diss", 2 * nu * F.col("enstrophy"))
    df = df.withColumn("etaK", F.pow(F.try_divide(F.lit(nu**3), F.col("diss")), 0.25)).withColumn("tauK", F.sqrt(F.try_divide(F.lit(nu), F.col("diss"))))
    df = df.withColumn("Re", F.col("Uint") * F.col("Lint") / nu).withColumn("lambda", F.sqrt(F.try_divide(15 * nu * F.col("Uint") * F.col("Uint"), F.col("diss"))))
    df = df.withColumn("Rlambda", F.col("Uint") * F.col("lambda") / nu)
    km = grid.km * (0.8 if grid.dealias == "smooth" else 1.0)  # the smooth rule's effective cut-off
    return df.withColumn("kMeta", km * F.col("etaK")).withColumn("Tint", F.try_divide(F.col("Lint"), F.col("Uint"))).withColumn("Taylor_microscale", F.col("lambda"))


def averaged(series: DataFrame, grid: Grid, viscosity: float) -> DataFrame:
    """One row: the scales of the averaged energy, enstrophy, Uint and Lint, not averages of scales."""
    mean = series.agg(*[F.avg(c).alias(c) for c in ("energy", "enstrophy", "Uint", "Lint")])
    return scales(mean, grid, float(viscosity))


def mean_tr_s2(invariants: DataFrame) -> DataFrame:
    return invariants.filter("quantity = 'TrS2'").select("snapshot", F.col("m1").alias("mean_trS2"))


def courant(moments: DataFrame, grid: Grid, dt: float) -> DataFrame:
    """Courant number of every snapshot."""
    return moments.filter("component = 'm'").select("snapshot", (dt * F.col("max") / grid.spacing("x")).alias("courant"))


def estimate_parameters(n: int, k_eta: float, dt_factor: float) -> dict[str, float]:
    """Viscosity, time step and forcing amplitude for a grid and a wanted resolution.

    The amplitudes of two grid sizes are fixed values.
    """
    return {"nu": (k_eta * 2.0 / n) ** (4.0 / 3), "dt": dt_factor / n, "famplitude": {288: 0.45, 576: 0.47}.get(n, 0.5)}


def qr_bounds(n: int, k_eta: float, viscosity: float) -> dict[str, float]:
    """Expected mean of TrS2, and the limits of the joint histogram of Q and R."""
    tr = (n // 2 / k_eta) ** 4 * viscosity**2
    return {"TrS2": tr, "Q": tr, "R": 0.4 * tr**1.5}
