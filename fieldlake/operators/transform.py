"""Fourier transforms between real and spectral fields.

The fast form works on slabs: planes of constant z are transformed in x and y, one shuffle
deals the rows out by ky, and each of those slabs is transformed in z.  Small snapshots are
transformed whole, many at a time.  The forward transform is not normalised; ``normalize``
divides by the number of points; the inverse is a plain sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.functions.grid import Grid
from fieldlake.model import MODE, POINT, RealField, SpectralField, need

_SLAB = "snapshot long, iz int, ky int, re array<double>, im array<double>"
#: Snapshots of up to so many bytes aren't cut into slabs.
SMALL_BYTES = 2**16


def _small(g: Grid, components: int) -> bool:
    return 8 * g.points * components <= SMALL_BYTES


def _signed(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.where(k <= n // 2, k, k - n)


def _by_group(df: DataFrame, keys: list[str], block: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Groups of rows with equal keys, many at a time: ``block`` gets whole groups, their rows' group numbers and their first rows."""
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []

        def flush(last: bool) -> Iterator[pd.DataFrame]:
            rows = pd.concat(waiting, ignore_index=True) if len(waiting) > 1 else waiting[0]
            k = rows[keys].to_numpy()
            new = np.r_[True, (k[1:] != k[:-1]).any(1)]
            at = np.nonzero(new)[0]
            end = len(rows) if last else at[-1]
            waiting[:] = [] if last else [rows.iloc[end:]]
            if end:
                yield block(rows.iloc[:end], np.cumsum(new)[:end] - 1, at[at < end])

        for batch in batches:
            if len(batch):
                waiting.append(batch)
                if (batch[keys].to_numpy()[-1] != waiting[0][keys].to_numpy()[0]).any():
                    yield from flush(False)
        if waiting:
            yield from flush(True)

    return df.select(columns).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def dft(field: RealField) -> SpectralField:
    """Real to half spectrum; missing points count as zero."""
    need(field, RealField, "dft")
    g, c, names = field.grid, field.components, field.values
    nkx = g.nx // 2 + 1
    values = ", ".join(f"re{k} double, im{k} double" for k in range(c))

    def modes(snapshot, ky, f: np.ndarray) -> pd.DataFrame:
        """Rows of (group, kz, kx, component) amplitudes, a group for each snapshot and ky."""
        n = g.nz * nkx
        out = {"snapshot": np.repeat(snapshot, n), "ky": np.repeat(ky, n), "kz": np.tile(np.repeat(_signed(g.nz), nkx), len(f)), "kx": np.tile(np.arange(nkx), g.nz * len(f))}
        return pd.DataFrame(out | {f"{part}{k}": x[..., k].ravel() for k in range(c) for part, x in (("re", f.real), ("im", f.imag))})

    def planes(pdf: pd.DataFrame, group: np.ndarray, first: np.ndarray) -> pd.DataFrame:
        a = np.zeros((len(first), g.ny, g.nx, c))
        a[group, pdf["iy"].to_numpy(), pdf["ix"].to_numpy()] = pdf[names].to_numpy()
        f = np.fft.fft(np.fft.rfft(a, axis=2), axis=1)
        snapshot, ky = pdf["snapshot"].to_numpy()[first], np.tile(_signed(g.ny), len(first))
        if g.nz == 1:  # nothing is left to do in z
            return modes(np.repeat(snapshot, g.ny), ky, f.reshape(-1, 1, nkx, c))
        f = f.reshape(len(ky), -1)
        return pd.DataFrame({"snapshot": np.repeat(snapshot, g.ny), "iz": np.repeat(pdf["iz"].to_numpy()[first], g.ny), "ky": ky, "re": list(f.real), "im": list(f.imag)})

    def pillars(pdf: pd.DataFrame, group: np.ndarray, first: np.ndarray) -> pd.DataFrame:
        a = np.zeros((len(first), g.nz, nkx, c), complex)
        a[group, pdf["iz"].to_numpy()] = (np.stack(pdf["re"].to_numpy()) + 1j * np.stack(pdf["im"].to_numpy())).reshape(-1, nkx, c)
        return modes(pdf["snapshot"].to_numpy()[first], pdf["ky"].to_numpy()[first], np.fft.fft(a, axis=1))

    def whole(pdf: pd.DataFrame, group: np.ndarray, first: np.ndarray) -> pd.DataFrame:
        a = np.zeros((len(first), g.nz, g.ny, g.nx, c))
        a[group, pdf["iz"].to_numpy(), pdf["iy"].to_numpy(), pdf["ix"].to_numpy()] = pdf[names].to_numpy()
        f = np.fft.fft(np.fft.fft(np.fft.rfft(a, axis=3), axis=2), axis=1).transpose(0, 2, 1, 3, 4)
        return modes(np.repeat(pdf["snapshot"].to_numpy()[first], g.ny), np.tile(_signed(g.ny), len(first)), f.reshape(-1, g.nz, nkx, c))

    schema = f"snapshot long, ky int, kz int, kx int, {values}"
    if g.nz > 1 and _small(g, c):
        return SpectralField(_by_group(field.df.select(*POINT, *names), ["snapshot"], whole, schema), g, c)
    out = _by_group(field.df.select(*POINT, *names), ["snapshot", "iz"], planes, schema if g.nz == 1 else _SLAB)
    if g.nz > 1:
        out = _by_group(out, ["snapshot", "ky"], pillars, schema)
    return SpectralField(out, g, c)


def ift(field: SpectralField) -> RealField:
    """Half spectrum to real; missing modes count as zero."""
    need(field, SpectralField, "ift")
    g, c, names = field.grid, field.components, field.values
    nkx = g.nx // 2 + 1

    def pillars(pdf: pd.DataFrame, group: np.ndarray, first: np.ndarray) -> pd.DataFrame:
        a = np.zeros((len(first), g.nz, nkx, c), complex)
        v = pdf[names].to_numpy().reshape(-1, c, 2)
        a[group, pdf["kz"].to_numpy() % g.nz, pdf["kx"].to_numpy()] = v[..., 0] + 1j * v[..., 1]
        f = (np.fft.ifft(a, axis=1) * g.nz).reshape(len(first) * g.nz, -1)
        head = {k: np.repeat(pdf[k].to_numpy()[first], g.nz) for k in ("snapshot", "ky")}
        return pd.DataFrame({"snapshot": head["snapshot"], "iz": np.tile(np.arange(g.nz), len(first)), "ky": head["ky"], "re": list(f.real), "im": list(f.imag)})

    def points(snapshot, iz, a: np.ndarray) -> pd.DataFrame:
        f = np.fft.irfft(np.fft.ifft(a, axis=1) * g.ny, n=g.nx, axis=2) * g.nx
        n = g.ny * g.nx
        out = {"snapshot": np.repeat(snapshot, n), "iz": np.repeat(iz, n), "iy": np.tile(np.repeat(np.arange(g.ny), g.nx), len(f)), "ix": np.tile(np.arange(g.nx), g.ny * len(f))}
        return pd.DataFrame(out | {f"v{k}": f[..., k].ravel() for k in range(c)})

    def planes(pdf: pd.DataFrame, group: np.ndarray, first: np.ndarray) -> pd.DataFrame:
        a = np.zeros((len(first), g.ny, nkx, c), complex)
        a[group, pdf["ky"].to_numpy() % g.ny] = (np.stack(pdf["re"].to_numpy()) + 1j * np.stack(pdf["im"].to_numpy())).reshape(-1, nkx, c)
        return points(pdf["snapshot"].to_numpy()[first], pdf["iz"].to_numpy()[first], a)

    def whole(pdf: pd.DataFrame, group: np.ndarray, first: np.ndarray) -> pd.DataFrame:
        a = np.zeros((len(first), g.nz, g.ny, nkx, c), complex)
        v = pdf[names].to_numpy().reshape(-1, c, 2)
        a[group, pdf["kz"].to_numpy() % g.nz, pdf["ky"].to_numpy() % g.ny, pdf["kx"].to_numpy()] = v[..., 0] + 1j * v[..., 1]
        f = (np.fft.ifft(a, axis=1) * g.nz).reshape(-1, g.ny, nkx, c)
        return points(np.repeat(pdf["snapshot"].to_numpy()[first], g.nz), np.tile(np.arange(g.nz), len(first)), f)

    def flat(pdf: pd.DataFrame, group: np.ndarray, first: np.ndarray) -> pd.DataFrame:
        a = np.zeros((len(first), g.ny, nkx, c), complex)
        v = pdf[names].to_numpy().reshape(-1, c, 2)
        a[group, pdf["ky"].to_numpy() % g.ny, pdf["kx"].to_numpy()] = v[..., 0] + 1j * v[..., 1]
        return points(pdf["snapshot"].to_numpy()[first], np.zeros(len(first), np.int32), a)

    schema = "snapshot long, iz int, iy int, ix int, " + ", ".join(f"v{k} double" for k in range(c))
    modes = field.df.select(*MODE, *names)
    if g.nz == 1:
        return RealField(_by_group(modes, ["snapshot"], flat, schema), g, c)
    if _small(g, c):
        return RealField(_by_group(modes, ["snapshot"], whole, schema), g, c)
    return RealField(_by_group(_by_group(modes, ["snapshot", "ky"], pillars, _SLAB), ["snapshot", "iz"], planes, schema), g, c)


def normalize(field):
    """Divided by the number of points."""
    n = float(field.grid.points)
    if isinstance(field, RealField):
        return field.map(*[F.col(v) / n for v in field.values])
    return field.map(*[(r / n, i / n) for r, i in field.pairs()])


def dft_sums(field: RealField) -> SpectralField:
    """The transform as three sums, one axis after another: no Python, for small grids."""
    need(field, RealField, "dft_sums")
    g, spark = field.grid, field.df.sparkSession
    df = field.df.select("snapshot", "iz", "iy", "ix", *[F.col(v).alias(f"re{k}") for k, v in enumerate(field.values)], *[F.lit(0.0).alias(f"im{k}") for k in range(field.components)])
    for axis, n in (("x", g.nx), ("y", g.ny), ("z", g.nz)):
        lo, hi = (0, n // 2) if axis == "x" else g.signed(n)
        modes = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias(f"k{axis}"))
        phase = F.pmod(F.col(f"i{axis}") * F.col(f"k{axis}"), F.lit(n)) * (2 * np.pi / n)
        cos, sin = F.cos(phase), F.sin(phase)
        keys = [k for k in df.columns if k not in field.values and k[:2] not in ("re", "im") and k != f"i{axis}"] + [f"k{axis}"]
        sums = []
        for k in range(field.components):
            re, im = F.col(f"re{k}"), F.col(f"im{k}")
            sums += [F.sum(re * cos + im * sin).alias(f"re{k}"), F.sum(im * cos - re * sin).alias(f"im{k}")]
        df = df.join(F.broadcast(modes)).groupBy(*keys).agg(*sums)  # as many rows as the axis has modes
    return SpectralField(df.select(*MODE, *[f"{p}{k}" for k in range(field.components) for p in ("re", "im")]), g, field.components)


def to_slabs(field: RealField) -> DataFrame:
    """One row for each plane of constant z: snapshot, iz, data (y, x, component; x before component fastest)."""
    g, c = field.grid, field.components
    cell = F.struct("iy", "ix", *field.values)
    rows = field.df.groupBy("snapshot", "iz").agg(F.sort_array(F.collect_list(cell)).alias("cells"))  # ny * nx cells
    return rows.select("snapshot", "iz", F.flatten(F.transform("cells", lambda p: F.array(*[p[v] for v in field.values]))).alias("data")) if g and c else rows


def from_slabs(slabs: DataFrame, grid: Grid, components: int) -> RealField:
    """The inverse of ``to_slabs``."""
    cells = slabs.select("snapshot", "iz", "data", F.explode(F.sequence(F.lit(0), F.lit(grid.ny * grid.nx - 1))).alias("p"))
    return RealField(
        cells.select("snapshot", "iz", F.floor(F.col("p") / grid.nx).cast("int").alias("iy"), (F.col("p") % grid.nx).cast("int").alias("ix"), *[F.get("data", F.col("p") * components + k).alias(f"v{k}") for k in range(components)]),
        grid, components,
    )


def transpose(field: RealField, axes: str = "xyz") -> RealField:
    """Axes renamed: ``axes`` says which old axis becomes x, y and z.  No data moves."""
    if sorted(axes) != ["x", "y", "z"]:
        raise ValueError("axes is an order of x, y and z")
    g = field.grid
    old = dict(zip("xyz", axes))
    grid = Grid(*(getattr(g, f"n{old[a]}") for a in "xyz"), *(getattr(g, f"dk{old[a]}") for a in "xyz"), dealias=g.dealias)
    return RealField(field.df.select("snapshot", *[F.col(f"i{old[a]}").alias(f"i{a}") for a in "zyx"], *field.values), grid, field.components)


def interleave(field: RealField) -> DataFrame:
    """One array of all components at each point."""
    return field.df.select(*POINT, F.array(*field.values).alias("v"))


def separate(df: DataFrame, grid: Grid, components: int) -> RealField:
    """The inverse of ``interleave``."""
    return RealField(df.select(*POINT, *[F.get("v", F.lit(k)).alias(f"v{k}") for k in range(components)]), grid, components)


def frames(field: RealField) -> DataFrame:
    """Components as rows: snapshot, c, iz, iy, ix, v."""
    return interleave(field).select("snapshot", F.posexplode("v").alias("c", "v"), "iz", "iy", "ix").select("snapshot", "c", "iz", "iy", "ix", "v")
