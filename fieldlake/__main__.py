"""python -m fieldlake JOB: runs, post-processing, conversions and registered queries."""

from __future__ import annotations

import argparse

FORCINGS = ("linear", "Kolmogorov", "none")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="fieldlake", description=__doc__)
    jobs = out.add_subparsers(dest="job", required=True)

    def job(name: str, what: str, *paths: str) -> argparse.ArgumentParser:
        p = jobs.add_parser(name, help=what)
        for path in paths:
            p.add_argument(path)
        return p

    def grid(p: argparse.ArgumentParser) -> None:
        p.add_argument("-n", type=int, default=32, help="points of an edge")
        p.add_argument("--dk", type=float, nargs=3, default=(1.0, 1.0, 1.0), metavar=("X", "Y", "Z"), help="wavenumber steps: 1 for an edge of 2 pi")
        p.add_argument("--dealias", choices=("smooth", "two_thirds"), default="smooth")

    def snapshots(p: argparse.ArgumentParser) -> None:
        grid(p)
        p.add_argument("--snapshots", type=int, nargs="*", help="all unless given")

    for name, what in (("simulate", "run a flow, with particles if any are asked for; a file named stop in the folder ends it"), ("statistics", "derived statistics of a run")):
        p = job(name, what, "path")
        grid(p)
        p.add_argument("--nu", type=float, default=0.1)
        p.add_argument("--dt", type=float, default=0.01)
        p.add_argument("--iterations", type=int, default=8)
        p.add_argument("--every-stat", type=int, default=1)
        p.add_argument("--every-output", type=int, help="as many as the iterations unless given")
        p.add_argument("--checkpoints-per-file", type=int, default=1)
        p.add_argument("--forcing", choices=FORCINGS, default="linear")
        p.add_argument("--forcing-amplitude", type=float, default=0.5)
        p.add_argument("--forcing-band", type=float, nargs=2, default=(2.0, 4.0), metavar=("LOW", "HIGH"))
        p.add_argument("--forcing-mode", type=int, default=1, help="of the Kolmogorov forcing")
        p.add_argument("--particles", type=int, default=0)
        p.add_argument("--neighbours", type=int, default=1)
        p.add_argument("--smoothness", type=int, default=1)
        p.add_argument("--steps", type=int, default=4, help="of the particles' multi-step rule")
        p.add_argument("--species", type=int, nargs=2, action="append", default=[], metavar=("NEIGHBOURS", "SMOOTHNESS"), help="one more kind of particles")
        p.add_argument("--sample", action="store_true", help="store velocity and acceleration at the particles")
        p.add_argument("--frozen", action="store_true", help="particles in a field that stands still")
        p.add_argument("--seed", type=int, default=7547)
        p.add_argument("--bins", type=int, default=129)
        p.add_argument("--max-velocity", type=float, default=1.0)
        p.add_argument("--max-vorticity", type=float, default=1.0)
        p.add_argument("--no-output", action="store_true")
    snapshots(job("fields", "velocity in real space of stored vorticity", "path", "out"))
    p = job("acceleration", "moments of velocity and acceleration, and their joint histogram", "path", "out")
    snapshots(p)
    p.add_argument("--nu", type=float, default=0.1)
    p.add_argument("--limits", type=float, nargs=2, default=(1.0, 1.0), metavar=("ACCELERATION", "VELOCITY"))
    p.add_argument("--bins", type=int, default=129)
    p = job("convert", "real-space quantities of stored vorticity", "path", "out")
    snapshots(p)
    p.add_argument("--quantities", nargs="+", default=["velocity"], choices=("velocity", "vorticity", "enstrophy", "TrS2", "pressure"))
    p = job("resize", "stored vorticity on another grid", "path", "out")
    snapshots(p)
    p.add_argument("--target", type=int, required=True, help="points of the other grid's edge")
    p = job("filter-test", "filtered deltas of three dimensions", "out")
    grid(p)
    p.add_argument("--length", type=float, default=1.0)
    p = job("native", "native files into a table", "out")
    grid(p)
    p.add_argument("--file", nargs=2, action="append", required=True, metavar=("ITERATION", "PATH"))
    p.add_argument("--name", default="vorticity")
    p.add_argument("--components", type=int, default=3)
    p.add_argument("--precision", choices=("double", "single"), default="double")
    p.add_argument("--space", choices=("real", "complex"), default="real")
    job("query", "show a registered query over a folder of tables", "name", "tables")
    return out


def parameters(args: argparse.Namespace):
    from fieldlake.plans.jobs import Parameters

    forcing = {"kind": args.forcing}
    if args.forcing == "linear":
        forcing |= {"amplitude": args.forcing_amplitude, "k0": args.forcing_band[0], "k1": args.forcing_band[1]}
    elif args.forcing == "Kolmogorov":
        forcing |= {"amplitude": args.forcing_amplitude, "mode": args.forcing_mode}
    return Parameters(
        n=args.n, dk=tuple(args.dk), dealias=args.dealias, nu=args.nu, dt=args.dt, niter_todo=args.iterations, niter_stat=args.every_stat, niter_out=args.every_output or args.iterations, checkpoints_per_file=args.checkpoints_per_file, forcing=forcing,
        nparticles=args.particles, neighbours=args.neighbours, smoothness=args.smoothness, steps=args.steps, species=tuple(map(tuple, args.species)), sample=args.sample, frozen=args.frozen, seed=args.seed, histogram_bins=args.bins,
        max_velocity=args.max_velocity, max_vorticity=args.max_vorticity,
    )


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)

    from pyspark.sql import SparkSession

    from fieldlake.functions.grid import Grid
    from fieldlake.plans import jobs, registry
    from fieldlake.sources import io

    spark = SparkSession.builder.appName("fieldlake").getOrCreate()
    if args.job == "query":
        registry.QUERIES[args.name](spark, args.tables).show(50, truncate=False)
        return 0
    if args.job in ("simulate", "statistics"):
        s = jobs.Simulation(spark, args.path, parameters(args), save=not args.no_output)
        if args.job == "simulate":
            print("iteration", s.run())
        else:
            s.derived().orderBy("snapshot").show(50, truncate=False)
        return 0
    edge = lambda n: Grid(n, n, n, *args.dk, args.dealias)
    g = edge(args.n)
    if args.job == "fields":
        jobs.velocity_fields(spark, args.path, g, args.snapshots, args.out)
    elif args.job == "resize":
        jobs.resize_job(spark, args.path, g, args.snapshots, edge(args.target), args.out)
    elif args.job == "filter-test":
        jobs.filter_test(spark, g, args.length).write.mode("overwrite").parquet(args.out)
    elif args.job == "native":
        io.binary_to_table(spark, {int(k): path for k, path in args.file}, args.out, args.name, g, args.components, args.precision, args.space)
    else:
        w = io.read_field(spark, args.path, "vorticity", g, "complex", args.snapshots, 3)
        found = jobs.convert(w, args.quantities) if args.job == "convert" else jobs.acceleration_statistics(w, args.nu, tuple(args.limits), args.bins)
        for name, df in found.items():
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
