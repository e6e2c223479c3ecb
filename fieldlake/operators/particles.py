"""Particles on a periodic grid: cells, interpolation, and trajectories.

Particles are (species, particle, x, y, z) or any subset of those with positions; fields are
sampled by a stencil join: the grid's x-lines meet the (2n+2)^2 lines around each particle, and
the sum along x happens inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.functions.grid import Grid
from fieldlake.functions.kernels import adams_bashforth, fd_weights, weights
from fieldlake.model import RealField, SpectralField, need
from fieldlake.operators.spectral import low_pass
from fieldlake.operators.transform import ift


def cell(x: Column, grid: Grid, axis: str) -> tuple[Column, Column]:
    """Number of the cell (wrapped) and offset in it, in cells.  The position itself isn't wrapped."""
    s = x / grid.spacing(axis)
    i = F.floor(s)
    return F.pmod(i, F.lit(getattr(grid, f"n{axis}"))).cast("int"), s - i


def locate(particles: DataFrame, grid: Grid) -> DataFrame:
    """``particles`` with cell (cx..) and offset (ox..) of each axis that it has a position for."""
    out = particles
    for a in "xyz":
        if a in particles.columns:
            i, o = cell(F.col(a), grid, a)
            out = out.withColumn(f"c{a}", i).withColumn(f"o{a}", o)
    return out


def lines(field: RealField) -> DataFrame:
    """The field's x-lines: snapshot, iz, iy and one array for each component."""
    cells = F.sort_array(F.collect_list(F.struct("ix", *field.values)))  # nx cells
    rows = field.df.groupBy("snapshot", "iz", "iy").agg(cells.alias("cells"))
    return rows.select("snapshot", "iz", "iy", *[F.col("cells")[v].alias(f"line{k}") for k, v in enumerate(field.values)])


def sample(particles: DataFrame, field: RealField, n: int, m: int, derivative: tuple[int, int, int] = (0, 0, 0), raw: bool = False) -> DataFrame:
    """``particles`` with the field's values s0.. at their positions, by snapshot.

    ``n`` neighbours and smoothness ``m`` choose the kernel (0: Lagrange; both 0: linear).  ``derivative`` orders
    are divided by the spacing's powers unless ``raw``.  Particles without a snapshot column meet
    every snapshot of the field.  Axes of one point need no position.
    """
    need(field, RealField, "sample")
    g, size = field.grid, 2 * n + 2
    keys = particles.columns
    located = locate(particles, g).withColumn("_row", F.monotonically_increasing_id())
    factor = 1.0
    own: set[str] = set()
    for a, d in zip("xyz", derivative):
        if a in particles.columns and getattr(g, f"n{a}") > 1:
            located = located.withColumn(f"w{a}", weights(n, m, F.col(f"o{a}"), d))
            own.add(a)
            factor *= 1.0 if raw else g.spacing(a) ** -d

    def axis(a: str, count: int):
        if a not in own:
            return F.array(F.struct(F.lit(0).alias("i"), F.lit(1.0).alias("w")))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.struct(F.pmod(F.col(f"c{a}") + k - n, F.lit(count)).cast("int").alias("i"), F.get(F.col(f"w{a}"), k).alias("w")))

    stencil = F.flatten(F.transform(axis("z", g.nz), lambda p: F.transform(axis("y", g.ny), lambda q: F.struct(p["i"].alias("iz"), q["i"].alias("iy"), (p["w"] * q["w"]).alias("w")))))
    spread = located.withColumn("s", F.explode(stencil)).select("_row", *keys, *[c for c in ("cx", "wx") if c in located.columns], "s.*")
    on = ["iz", "iy"] + (["snapshot"] if "snapshot" in keys else [])
    met = spread.join(lines(field), on)
    if "x" in own:
        along = lambda line: F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0.0), lambda t, k: t + F.get(F.col("wx"), k) * F.get(line, F.pmod(F.col("cx") + k - n, F.lit(g.nx)).cast("int")))
    else:
        along = lambda line: F.get(line, F.lit(0))
    group = list(dict.fromkeys(["_row", *keys, "snapshot"]))  # equal particles stay apart
    return met.groupBy(*group).agg(*[(F.sum(F.col("w") * along(F.col(f"line{k}"))) * factor).alias(f"s{k}") for k in range(field.components)]).drop("_row")


def filtered_samples(particles: DataFrame, field: SpectralField, cutoffs: list[float], n: int, m: int) -> DataFrame:
    """Samples of the field low-passed at each cutoff, with a column kcut."""
    out = None
    for k in cutoffs:
        part = sample(particles, ift(low_pass(field, k)), n, m).withColumn("kcut", F.lit(float(k)))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("at least one cutoff is needed")
    return out


def multi_step(rhs: list[Column], order: Column, dt: float) -> Column:
    """dt times the Adams-Bashforth sum of the newest right-hand sides; ``order`` says how many there are."""
    out = F.lit(None).cast("double")
    for s in range(len(rhs), 0, -1):
        terms = [float(c) * r for c, r in zip(adams_bashforth(s), rhs)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out = F.when(order == s, dt * total).otherwise(out)
    return out


def integrate(series: DataFrame, keys: list[str], step: str, rhs: str, dt: float, steps: int) -> DataFrame:
    """Displacement and position of each particle at every stored step from its right-hand sides.

    The start uses as many sides as there are so far.
    """
    w = Window.partitionBy(*keys).orderBy(step)
    seen = F.least(F.row_number().over(w), F.lit(steps))
    sides = [F.col(rhs) if k == 0 else F.lag(rhs, k).over(w) for k in range(steps)]
    moved = series.select(*keys, step, rhs, seen.alias("order"), *[s.alias(f"r{k}") for k, s in enumerate(sides)])
    moved = moved.withColumn("dx", multi_step([F.col(f"r{k}") for k in range(steps)], F.col("order"), dt))
    return moved.select(*keys, step, "order", "dx", F.sum("dx").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("displacement"))


def push(history: Column, new: Column, steps: int) -> Column:
    """The ring of right-hand sides, newest first."""
    return F.slice(F.concat(F.array(new), history), 1, steps)


def advance(particles: DataFrame, velocity: DataFrame, key: str, dt: float, steps: int) -> DataFrame:
    """Particles (key, x, y, z, step, rhs: array of structs) moved one step by sampled velocities (key, s0, s1, s2)."""
    met = particles.join(velocity.select(key, F.struct(F.col("s0").alias("x"), F.col("s1").alias("y"), F.col("s2").alias("z")).alias("new")), key)
    met = met.withColumn("rhs", push(F.col("rhs"), F.col("new"), steps))
    order = F.least(F.size("rhs"), F.lit(steps))
    out = {a: F.col(a) + multi_step([F.get("rhs", F.lit(k))[a] for k in range(steps)], order, dt) for a in "xyz"}
    return met.select(key, *[out[a].alias(a) for a in "xyz"], (F.col("step") + 1).alias("step"), "rhs")


def finite_difference_test(series: DataFrame, keys: list[str], step: str, x: str, v: str, dt: float, m: int) -> DataFrame:
    """How well the derivative of a stored position agrees with the sampled velocity: snr in decibel by particle."""
    w = Window.partitionBy(*keys).orderBy(step)
    coefficients = fd_weights(list(range(-m, m + 1)), 1)
    total = F.lit(0.0)
    for k, c in zip(range(-m, m + 1), coefficients):
        if c:
            total = total + float(c) / dt * (F.lag(x, -k).over(w) if k < 0 else F.lead(x, k).over(w))
    rows = series.select(*keys, step, F.col(v).alias("v"), total.alias("d")).filter(F.col("d").isNotNull())
    ratio = F.try_divide(F.avg((F.col("d") - F.col("v")) * (F.col("d") - F.col("v"))), F.avg(F.col("v") * F.col("v")))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), (-10 * F.log10(ratio)).alias("snr"))


def euler(x, f, dt: float):
    return x + dt * f(x)


def heun(x, f, dt: float):
    k = f(x)
    return x + 0.5 * dt * (k + f(x + dt * k))


def runge_kutta(x, f, dt: float):
    """Classical, of fourth order; works on Columns and on numbers, like the two above."""
    a = f(x)
    b = f(x + 0.5 * dt * a)
    c = f(x + 0.5 * dt * b)
    d = f(x + dt * c)
    return x + dt / 6 * (a + 2 * b + 2 * c + d)


def redistribute(particles: DataFrame, grid: Grid, partitions: int) -> DataFrame:
    """Dealt out by the cell in z, so that neighbours stand together."""
    i, _ = cell(F.col("z"), grid, "z")
    return particles.withColumn("iz", i).repartitionByRange(partitions, "iz", "particle").drop("iz")
