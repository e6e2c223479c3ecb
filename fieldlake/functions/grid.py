"""Periodic grids and their wavenumbers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEALIASING = ("smooth", "two_thirds")


@dataclass(frozen=True)
class Grid:
    """Points and wavenumber steps of each axis, and the dealiasing rule.

    ``km`` is the largest resolved wavenumber over the axes and ``dk`` the least step; a box is
    2 pi / step long.
    """

    nx: int
    ny: int = 1
    nz: int = 1
    dkx: float = 1.0
    dky: float = 1.0
    dkz: float = 1.0
    dealias: str = "smooth"

    def __post_init__(self):
        if self.dealias not in DEALIASING:
            raise ValueError(f"dealiasing is one of {DEALIASING}")
        if min(self.nx, self.ny, self.nz) < 1 or min(self.dkx, self.dky, self.dkz) <= 0:
            raise ValueError("sizes and steps are positive")

    @property
    def points(self) -> int:
        return self.nx * self.ny * self.nz

    @property
    def dk(self) -> float:
        return min(self.dkx, self.dky, self.dkz)

    @property
    def km(self) -> float:
        part = (lambda n: n // 2 - 1) if self.dealias == "smooth" else (lambda n: n // 3 - 1)
        return max(d * part(n) for d, n in ((self.dkx, self.nx), (self.dky, self.ny), (self.dkz, self.nz)))

    @property
    def shells(self) -> int:
        return int(self.km / self.dk) + 2

    def spacing(self, axis: str) -> float:
        return 2 * math.pi / (getattr(self, f"dk{axis}") * getattr(self, f"n{axis}"))

    def wave(self, axis: str) -> Column:
        """The axis's wavenumber from its signed integer."""
        d = getattr(self, f"dk{axis}")
        k = F.col(f"k{axis}").cast("double")
        return k if d == 1 else k * d

    @property
    def k2(self) -> Column:
        x, y, z = (self.wave(a) for a in "xyz")
        return x * x + y * y + z * z

    @property
    def shell(self) -> Column:
        return F.floor(F.sqrt(self.k2) / self.dk).cast("int")

    def signed(self, n: int) -> tuple[int, int]:
        """Least and largest signed integer of an axis; the middle one is positive."""
        return -((n - 1) // 2), n // 2

    def modes(self, spark: SparkSession) -> DataFrame:
        """ky, kz, kx of the half spectrum."""
        nkx = self.nx // 2 + 1
        signed = lambda k, n: F.when(k <= n // 2, k).otherwise(k - n).cast("int")
        at = F.col("id")
        ky, kz = F.floor(at / (nkx * self.nz)), F.pmod(F.floor(at / nkx), F.lit(self.nz))
        return spark.range(self.ny * self.nz * nkx).select(signed(ky, self.ny).alias("ky"), signed(kz, self.nz).alias("kz"), F.pmod(at, F.lit(nkx)).cast("int").alias("kx"))

    def coordinates(self, spark: SparkSession, axis: str) -> DataFrame:
        """Positions of the axis's points."""
        n = getattr(self, f"n{axis}")
        return spark.range(n).select(F.col("id").cast("int").alias(f"i{axis}"), (F.col("id") * self.spacing(axis)).alias(axis))


def nxmodes() -> Column:
    """How many modes of the whole spectrum a mode of the half spectrum stands for: 1 at kx = 0, else 2."""
    return F.when(F.col("kx") == 0, F.lit(1)).otherwise(F.lit(2))


def shell_table(grid: Grid, spark: SparkSession) -> DataFrame:
    """shell, kshell (mean wavenumber) and nshell (modes) over k2 < km^2; empty shells have 0 and 0."""
    inside = grid.modes(spark).withColumn("k2", grid.k2).filter(F.col("k2") < grid.km**2)
    found = inside.withColumn("shell", grid.shell).groupBy("shell").agg(F.sum(nxmodes()).cast("long").alias("nshell"), F.sum(nxmodes() * F.sqrt("k2")).alias("total"))
    every = spark.range(grid.shells).select(F.col("id").cast("int").alias("shell"))
    return every.join(found, "shell", "left").select(
        "shell", F.coalesce(F.col("total") / F.col("nshell"), F.lit(0.0)).alias("kshell"), F.coalesce("nshell", F.lit(0)).cast("long").alias("nshell")
    )
