"""Fields as DataFrames.

A real field has columns snapshot, iz, iy, ix and v0..; a spectral field snapshot, ky, kz, kx
(signed integers, kx >= 0) and re0, im0, ...  One, three or nine components are one column (or
pair) each, so that projections reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.functions.grid import Grid

POINT = ("snapshot", "iz", "iy", "ix")
MODE = ("snapshot", "ky", "kz", "kx")


@dataclass(frozen=True)
class RealField:
    """``whole``, where it is known, has the same points as one row for each snapshot: v0.. are arrays in the order of iz, iy and ix.

    ``line``, where it is known, is the same for the first line along x alone, without what the other points cost.
    """

    df: DataFrame
    grid: Grid
    components: int = 1
    whole: DataFrame | None = None
    line: DataFrame | None = None

    @property
    def values(self) -> list[str]:
        return [f"v{c}" for c in range(self.components)]

    def with_df(self, df: DataFrame, components: int | None = None) -> RealField:
        return replace(self, df=df, components=self.components if components is None else components, whole=None, line=None)

    def of_snapshots(self, condition) -> RealField:
        """The snapshots for whose numbers the condition holds."""
        own = lambda rows: None if rows is None else rows.filter(condition)
        return replace(self, df=self.df.filter(condition), whole=own(self.whole), line=own(self.line))

    def map(self, *values) -> RealField:
        """Other values at the same points."""
        return self.with_df(self.df.select(*POINT, *[v.alias(f"v{c}") for c, v in enumerate(values)]), len(values))

    def join(self, other: RealField, prefix: str = "w") -> DataFrame:
        """Both fields' values at each point; the other's are named by ``prefix``."""
        right = other.df.select(*POINT, *[F.col(v).alias(prefix + v[1:]) for v in other.values])
        return self.df.select(*POINT, *self.values).join(right, list(POINT))


@dataclass(frozen=True)
class SpectralField:
    df: DataFrame
    grid: Grid
    components: int = 1

    @property
    def values(self) -> list[str]:
        return [f"{part}{c}" for c in range(self.components) for part in ("re", "im")]

    def with_df(self, df: DataFrame, components: int | None = None) -> SpectralField:
        return replace(self, df=df, components=self.components if components is None else components)

    def pairs(self) -> list[tuple]:
        return [(F.col(f"re{c}"), F.col(f"im{c}")) for c in range(self.components)]

    def map(self, *pairs) -> SpectralField:
        """Other amplitudes, (re, im) each, at the same modes."""
        columns = [x.alias(f"{part}{c}") for c, pair in enumerate(pairs) for part, x in zip(("re", "im"), pair)]
        return self.with_df(self.df.select(*MODE, *columns), len(pairs))

    def scale(self, factor) -> SpectralField:
        return self.map(*[(r * factor, i * factor) for r, i in self.pairs()])

    def keep(self, condition) -> SpectralField:
        """Zero where the condition fails; the modes stay, so the field is dense."""
        return self.map(*[(F.when(condition, r).otherwise(0.0), F.when(condition, i).otherwise(0.0)) for r, i in self.pairs()])

    def join(self, other: SpectralField, prefix: str = "o") -> DataFrame:
        right = other.df.select(*MODE, *[F.col(v).alias(prefix + v) for v in other.values])
        return self.df.select(*MODE, *self.values).join(right, list(MODE))


def points(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, p and values of every place p of arrays at which each of them has a value."""
    first, *others = values
    out = rows.select(*keys, F.posexplode(first).alias("p", "_0"), *others)
    out = out.select(*keys, "p", F.col("_0").cast("double").alias(first), *[F.get(v, F.col("p")).cast("double").alias(v) for v in others])
    return out.filter(" and ".join(f"{v} is not null" for v in values))


def need(field, kind: type, what: str) -> None:
    """A field in the wrong space is an error at once."""
    if not isinstance(field, kind):
        raise TypeError(f"{what} takes a {kind.__name__}, not a {type(field).__name__}")


def components_of(field, *allowed: int) -> None:
    if field.components not in allowed:
        raise TypeError(f"{field.components} components, where {' or '.join(map(str, allowed))} are needed")
