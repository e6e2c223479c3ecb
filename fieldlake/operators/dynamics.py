"""The vorticity equation in time, with particles carried along."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as default

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.model import RealField, SpectralField
from fieldlake.operators.particles import advance, sample
from fieldlake.operators.spectral import add_forcing, cross_pairs, dealias, divergence_free, forced_pairs, invert_curl, solenoidal_pairs, symmetrize, velocity_pairs
from fieldlake.operators.stats import cospectrum, cross_product_within, histogram, moments
from fieldlake.operators.transform import dft, ift
from fieldlake.sources.shared import drop_written, written


@dataclass(frozen=True)
class Flow:
    """What a run needs besides its initial vorticity."""

    viscosity: float = 0.1
    dt: float = 0.01
    forcing: dict = default(default_factory=lambda: {"kind": "linear", "amplitude": 0.5, "k0": 2.0, "k1": 4.0})
    frozen: bool = False


def nonlinear(w: SpectralField, forcing: dict | None) -> SpectralField:
    """Right-hand side of the vorticity equation without viscosity."""
    return divergence_free(add_forcing(_transport(w), w, 1.0, forcing))


def _transport(w: SpectralField) -> SpectralField:
    """The curl of velocity times vorticity, of the first three components.

    Both go through one transform side by side, so that their product needs no join.
    """
    both = ift(w.map(*velocity_pairs(w), *w.pairs()[:3]))
    product = dealias(dft(cross_product_within(both)))
    return product.map(*cross_pairs(product, F.lit(1.0), product.grid.k2 <= product.grid.km**2))


def _cut(f: SpectralField, name: str) -> SpectralField:
    return f.with_df(written(f.df, name))


def _cut_real(f: RealField, name: str) -> RealField:
    return f.with_df(written(f.df, name))


def step(w: SpectralField, flow: Flow) -> SpectralField:
    """One step in time: three stages with exact viscous factors.  Each stage is written down, so plans stay short."""
    if flow.frozen:
        return w
    g, dt = w.grid, flow.dt
    inside = g.k2 <= g.km**2
    decay = lambda s: F.exp(-flow.viscosity * g.k2 * s)

    def stage(state: SpectralField, form: Callable) -> SpectralField:
        """The next state and, behind it, the step's first one, by an expression of the first state, the present one and its right-hand side.

        ``state`` holds both (at the start, one for both), so the right-hand side meets them in one join.
        """
        n = _transport(state)
        met = n.with_df(n.join(state, "b"))
        f = met.map(*met.pairs(), *[(F.col(f"bre{c}"), F.col(f"bim{c}")) for c in range(state.components)])
        f = f.map(*forced_pairs(f, f.pairs()[3:6], 1.0, flow.forcing)[:3], *f.pairs()[3:])
        f = f.map(*solenoidal_pairs(f), *f.pairs()[3:])
        sides, present, first = f.pairs()[:3], f.pairs()[3:6], f.pairs()[-3:]
        new = [tuple(F.when(inside, form(*parts)).otherwise(0.0) for parts in zip(*pairs)) for pairs in zip(first, present, sides)]
        return f.map(*new, *first)

    v1 = _cut(stage(w, lambda a, b, n: (b + dt * n) * decay(dt)), "stage-1")
    v2 = _cut(stage(v1, lambda a, b, n: 0.25 * (3 * a * decay(dt / 2) + (b + dt * n) * decay(-dt / 2))), "stage-2")
    v3 = stage(v2, lambda a, b, n: (a * decay(dt / 2) + 2 * (b + dt * n)) * decay(dt / 2) / 3)
    v3 = v3.map(*v3.pairs()[:3])
    v3 = _cut(divergence_free(v3), "stage-3")
    out = _cut(symmetrize(v3), "step")  # reads its input three times, so not the whole stage
    for old in (v1, v2, v3):
        drop_written(old.df)
    return out


def carry(particles: DataFrame, w: SpectralField, flow: Flow, neighbours: int, smoothness: int, steps: int) -> DataFrame:
    """Particles moved with the velocity of the present vorticity."""
    return _carried(particles, ift(invert_curl(w)), flow, neighbours, smoothness, steps)


def _carried(particles: DataFrame, u: RealField, flow: Flow, neighbours: int, smoothness: int, steps: int) -> DataFrame:
    found = sample(particles.select("particle", "x", "y", "z"), u, neighbours, smoothness)
    return written(advance(particles.select("particle", "x", "y", "z", "step", "rhs"), found, "particle", flow.dt, steps), "particles")


def run(
    w: SpectralField, flow: Flow, iterations: int, *, particles: DataFrame | None = None, neighbours: int = 1, smoothness: int = 1, steps: int = 4,
    every_stat: int = 1, every_out: int = 0, on_stats: Callable | None = None, on_output: Callable | None = None, stop: Callable[[], bool] | None = None, first: int = 0, drop: bool = False,
) -> tuple[SpectralField, DataFrame | None, int]:
    """Iterations ``first`` .. ``first + iterations``: statistics, output, particles, then the fluid.

    ``on_stats`` and ``on_output`` get (iteration, vorticity, particles); both are also called at
    the end.  ``stop`` is asked before every iteration.  ``particles`` may be one frame for each
    species, and then so are ``neighbours``, ``smoothness`` and ``steps``.  With ``drop`` the
    folders of past states go, so nothing may read them later.  Returns the last state and its
    iteration.
    """
    if every_out and iterations % every_out:
        raise ValueError("the number of iterations is a multiple of the output's interval")
    k = first
    while True:
        due = k == first + iterations or bool(stop and k > first and stop())
        if on_stats and (due or k % every_stat == 0):
            on_stats(k, w, particles)
        if on_output and (due or every_out and k % every_out == 0):
            on_output(k, w, particles)
        if due:
            return w, particles, k
        if particles is not None:
            past = particles
            if isinstance(particles, dict):
                u = _cut_real(ift(invert_curl(w)), "velocity")
                particles = {s: _carried(p, u, flow, neighbours[s], smoothness[s], steps[s]) for s, p in particles.items()}
                drop_written(u.df)
            else:
                particles = carry(particles, w, flow, neighbours, smoothness, steps)
            if drop:
                for p in past.values() if isinstance(past, dict) else [past]:
                    drop_written(p)
        past_w, w = w, step(w, flow)
        if drop and past_w is not w:
            drop_written(past_w.df)
        k += 1


def flow_stats(w: SpectralField, iteration: int, limits: dict[str, float] | None = None, bins: int = 129) -> dict[str, DataFrame]:
    """Moments, histograms and spectra of velocity and vorticity, keyed by iteration.

    ``limits`` are those of the histograms, by field: of a magnitude, and by the root of 3 of a component.
    """
    limits = {"velocity": 1.0, "vorticity": 1.0} | (limits or {})
    mark = lambda df: df.withColumn("snapshot", F.lit(iteration).cast("long"))
    out = {}
    for name, f in (("velocity", invert_curl(w)), ("vorticity", w)):
        real, most = ift(f), limits[name]
        out |= {f"{name}_moments": mark(moments(real)), f"{name}_histogram": mark(histogram(real, [most / 3**0.5] * 3 + [most], bins)), f"{name}_spectrum": mark(cospectrum(f))}
    return out
