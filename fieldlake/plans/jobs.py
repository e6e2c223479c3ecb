"""Jobs: simulations, post-processing and conversions, by name and parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.functions.grid import Grid, shell_table
from fieldlake.model import SpectralField
from fieldlake.operators import derived as D
from fieldlake.operators import dynamics as W
from fieldlake.operators import generate as G
from fieldlake.operators import particles as P
from fieldlake.operators import spectral as S
from fieldlake.operators import stats as A
from fieldlake.operators import transform as T
from fieldlake.sources import io


@dataclass
class Parameters:
    """What a simulation is run with."""

    n: int = 32
    dt: float = 0.01
    nu: float = 0.1
    niter_todo: int = 8
    niter_stat: int = 1
    niter_out: int = 8
    checkpoints_per_file: int = 1
    forcing: dict = field(default_factory=lambda: {"kind": "linear", "amplitude": 0.5, "k0": 2.0, "k1": 4.0})
    dealias: str = "smooth"
    dk: tuple[float, float, float] = (1.0, 1.0, 1.0)
    nparticles: int = 0
    neighbours: int = 1
    smoothness: int = 1
    steps: int = 4
    frozen: bool = False
    seed: int = 7547
    histogram_bins: int = 129
    max_velocity: float = 1.0
    max_vorticity: float = 1.0
    #: Further kinds of particles, (neighbours, smoothness) each, that start where the first do.
    species: tuple[tuple[int, int], ...] = ()
    sample: bool = False

    @property
    def grid(self) -> Grid:
        return Grid(self.n, self.n, self.n, *self.dk, self.dealias)

    @property
    def flow(self) -> W.Flow:
        return W.Flow(self.nu, self.dt, self.forcing, self.frozen)


class Simulation:
    """A run under a folder: checkpoints, statistics and particles; it goes on from its last checkpoint.

    A file ``stop`` in the folder ends it after the present iteration, with a checkpoint.
    Subclasses change what happens by overriding ``initial``, ``statistics`` or ``output``.
    """

    def __init__(self, spark: SparkSession, path: str, parameters: Parameters | None = None, save: bool = True):
        self.spark, self.path, self.p, self.save = spark, path, parameters or Parameters(), save
        self.checkpoints = io.Checkpoints(spark, f"{path}/checkpoints", self.p.grid, self.p.checkpoints_per_file)

    def initial(self) -> SpectralField:
        v = G.random_vector(self.spark, self.p.grid, seed=self.p.seed)
        return S.divergence_free(S.low_pass(S.symmetrize(v), self.p.grid.km))

    def tracers(self) -> DataFrame | None:
        return G.tracers(self.spark, self.p.nparticles) if self.p.nparticles else None

    def statistics(self, iteration: int, w: SpectralField, particles: DataFrame | None) -> None:
        limits = {"velocity": self.p.max_velocity, "vorticity": self.p.max_vorticity}
        for name, df in W.flow_stats(w, iteration, limits, self.p.histogram_bins).items():
            # An iteration's folder is replaced, so that a restart repeats nothing.
            df.drop("snapshot").write.mode("overwrite").parquet(f"{self.path}/statistics/{name}/snapshot={iteration}")
        if self.p.sample and particles is not None:
            self.samples(iteration, w, particles)

    def samples(self, iteration: int, w: SpectralField, particles) -> None:
        """Velocity and Lagrangian acceleration at the particles, by species; steps that are there stay."""
        u = S.invert_curl(w)
        ru = T.ift(u)
        fields = {"velocity": ru, "acceleration": T.ift(S.lagrangian_acceleration(u, S.pressure(ru), self.p.nu, self.p.forcing))}
        for species, frame in (particles if isinstance(particles, dict) else {0: particles}).items():
            n, m = self.kinds[species]
            for name, f in fields.items():
                found = P.sample(frame.select("particle", "x", "y", "z"), f, n, m).withColumn("step", F.lit(iteration).cast("long"))
                io.append_samples(found, f"{self.path}/samples/species={species}", name)

    @property
    def kinds(self) -> dict[int, tuple[int, int]]:
        """Neighbours and smoothness of every species."""
        return dict(enumerate(((self.p.neighbours, self.p.smoothness), *self.p.species)))

    def output(self, iteration: int, w: SpectralField, particles) -> None:
        self.checkpoints.write(w, iteration)
        for species, frame in (particles if isinstance(particles, dict) else {0: particles}).items():
            if frame is not None:
                frame.drop("species").write.mode("overwrite").parquet(f"{self.path}/particles/iteration={iteration}/species={species}")

    def run(self) -> int:
        """Iterations up to the next multiple of niter_todo; the last iteration's number."""
        first = self.checkpoints.last() if self.save else None
        particles = self.tracers()
        if first is not None:
            w = self.checkpoints.read(first)
            w = w.with_df(w.df.withColumn("snapshot", F.lit(0).cast("long")))
            if particles is not None:
                stored = self.spark.read.parquet(f"{self.path}/particles").filter(F.col("iteration") == first).drop("iteration")
                particles = {k: stored.filter(F.col("species") == k).drop("species") for k in self.kinds} if self.p.species else stored.filter("species = 0").drop("species")
        else:
            first, w = 0, self.initial()
            if particles is not None and self.p.species:
                particles = {k: particles for k in self.kinds}
            io.store_shells(self.p.grid, self.spark, f"{self.path}/shells")
            if self.save:
                self.output(0, w, particles)
        count = self.p.niter_todo - first % self.p.niter_todo
        every = self.p.niter_out if count % self.p.niter_out == 0 else count

        def save(k, v, q):
            if self.save and k > first:
                self.output(k, v, q)

        many = isinstance(particles, dict)
        by = (lambda i: {k: v[i] for k, v in self.kinds.items()}) if many else (lambda i: self.kinds[0][i])
        steps = dict.fromkeys(self.kinds, self.p.steps) if many else self.p.steps
        stop = lambda: io._exists(self.spark, f"{self.path}/stop")
        _, _, last = W.run(w, self.p.flow, count, particles=particles, neighbours=by(0), smoothness=by(1), steps=steps, stop=stop, drop=True, every_stat=self.p.niter_stat, every_out=every, on_stats=self.statistics, on_output=save, first=first)
        return last

    def derived(self, first: int = 0, last: int = 2**31) -> DataFrame:
        """Scales of every stored statistics' iteration in a window."""
        spectrum = lambda q: D.window(self.spark.read.parquet(f"{self.path}/statistics/{q}_spectrum").withColumn("snapshot", F.col("snapshot").cast("long")), first, last)
        energy, enstrophy = D.shell_energy(spectrum("velocity")), D.shell_energy(spectrum("vorticity"))
        return D.per_time(energy, enstrophy, shell_table(self.p.grid, self.spark), self.p.grid, self.p.nu)


def velocity_fields(spark: SparkSession, path: str, grid: Grid, snapshots: list[int] | None, out: str) -> None:
    """Velocity in real space of stored vorticity; all snapshots at once."""
    w = io.read_field(spark, path, "vorticity", grid, "complex", snapshots, 3)
    io.write_field(T.ift(S.invert_curl(w)), out, "velocity")


def acceleration_statistics(w: SpectralField, viscosity: float, limits: tuple[float, float], bins: int, forcing: dict | None = None) -> dict[str, DataFrame]:
    """Moments of velocity and Lagrangian acceleration, and their joint histogram; all snapshots at once."""
    u = S.invert_curl(w)
    ru = T.ift(u)
    ra = T.ift(S.lagrangian_acceleration(u, S.pressure(ru), viscosity, forcing))
    return {"velocity": A.moments(ru), "acceleration": A.moments(ra), "joint": A.joint_histogram(ra, ru, limits[0], limits[1], bins)}


def filter_test(spark: SparkSession, grid: Grid, length: float) -> DataFrame:
    """Filtered deltas of three dimensions by the three filters: dimension, filter, snapshot, point, v0."""
    out = None
    for dimension in (0, 1, 2):
        f = T.normalize(T.dft(G.delta(spark, grid, dimension)))
        for kind in S.FILTERS:
            part = T.ift(S.filter_length(f, length, kind)).df.withColumn("dimension", F.lit(dimension)).withColumn("filter", F.lit(kind))
            out = part if out is None else out.unionByName(part)
    return out


def convert(w: SpectralField, wanted: list[str], viscosity: float = 0.0) -> dict[str, DataFrame]:
    """Real-space quantities of stored vorticity: velocity, vorticity, enstrophy, TrS2, pressure."""
    u = S.invert_curl(w)
    makers: dict[str, Callable] = {
        "velocity": lambda: T.ift(u), "vorticity": lambda: T.ift(w), "enstrophy": lambda: A.enstrophy(T.ift(w)), "pressure": lambda: T.ift(S.pressure(T.ift(u))),
        "TrS2": lambda: (g := A.gradient_invariants(T.ift(S.gradient(u)))).map(F.col("v0")),
    }
    return {name: makers[name]().df for name in wanted}


def resize_job(spark: SparkSession, path: str, grid: Grid, snapshots: list[int] | None, target: Grid, out: str) -> None:
    """Stored vorticity on another grid."""
    io.write_field(S.resize(io.read_field(spark, path, "vorticity", grid, "complex", snapshots, 3), target), out, "vorticity", "overwrite")
