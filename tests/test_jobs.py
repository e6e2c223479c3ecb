import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldlake.functions.grid import Grid
from fieldlake.operators import particles as P
from fieldlake.operators import spectral as S
from fieldlake.operators import generate as G
from fieldlake.plans import jobs
from fieldlake.sources import io
from fieldlake.streaming import tracers


def test_restarts_go_on(spark, tmp_path):
    p = jobs.Parameters(n=8, niter_todo=1, niter_out=1, nparticles=5)
    s = jobs.Simulation(spark, f"file://{tmp_path}/run", p)
    assert (s.run(), s.run()) == (1, 2)
    assert s.derived().filter("energy > 0").count() == 3
    assert spark.read.parquet(f"file://{tmp_path}/run/particles").filter("iteration = 2 and step = 2").count() == 5


def test_filtered_deltas_keep_their_integral(spark):
    g = Grid(8, 8, 8)
    got = jobs.filter_test(spark, g, 1.0).groupBy("dimension", "filter").agg(F.avg("v0").alias("m")).collect()
    assert len(got) == 9
    for r in got:
        assert r["m"] * (2 * 3.141592653589793) ** (3 - r["dimension"]) == pytest.approx(1, rel=1e-6)


def test_acceleration_statistics_and_conversion(spark):
    w = G.abc_modes(spark, Grid(8, 8, 8), 1.0, 0.7, 0.5)
    out = jobs.acceleration_statistics(w, 0.1, (5.0, 5.0), 8)
    assert out["joint"].filter("comp1 = 'm'").agg(F.sum("cnt")).first()[0] == 512
    got = jobs.convert(w, ["velocity", "vorticity", "enstrophy", "TrS2", "pressure"])
    assert {df.count() for df in got.values()} == {512}
    # The flow is its own curl, and a steady solution: its pressure is -u^2 / 2 but for the mean.
    both = got["pressure"].withColumnRenamed("v0", "p").join(got["enstrophy"].withColumnRenamed("v0", "e"), ["snapshot", "iz", "iy", "ix"])
    r = both.agg(F.stddev_pop(F.col("p") + F.col("e")).alias("s"), F.stddev_pop("e").alias("of")).first()
    assert r["s"] < 1e-3 * r["of"]


def test_streams_agree_with_batches(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    series = spark.createDataFrame([(p, k, float((p * 7 + k * 3) % 11)) for p in range(4) for k in range(1, 9)], "particle long, step long, v double")
    for lo, hi in ((1, 4), (5, 8)):
        series.filter(F.col("step").between(lo, hi)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema(series.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s")
    q = tracers.integrate(stream, "particle", "step", "v", 0.1, 3).writeStream.format("memory").queryName("moved").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["particle"], r["step"]): r["x"] for r in spark.table("moved").collect()}
    want = {(r["particle"], r["step"]): r["displacement"] for r in P.integrate(series, ["particle"], "step", "v", 0.1, 3).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    rows.select("ts", "event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/e")
    q = tracers.windowed_moments(stream, "ts", ["event_type"], "value", "1 day", "1 hour").writeStream.format("memory").queryName("m").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert isinstance(spark.table("m").toPandas(), pd.DataFrame)


def test_parameters(spark, tmp_path):
    p = {"s": "text", "r": 1.21, "list": [1.3, 1.5, 0.4], "ints": [1, 3, 5, 4], "big": 2**40}
    io.write_parameters(spark, f"file://{tmp_path}/p", p)
    assert io.read_parameters(spark, f"file://{tmp_path}/p") == p


def test_sparse_low_pass_reaches_the_scan(spark, tmp_path):
    f = G.random_scalar(spark, Grid(8, 8, 8))
    io.write_field(f, f"file://{tmp_path}/f", "w")
    back = io.read_field(spark, f"file://{tmp_path}/f", "w", f.grid, "complex", [0])
    plan = back.df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(snapshot" in plan or "PartitionFilters: [(snapshot" in plan or "PartitionFilters: [cast(snapshot" in plan or "snapshot#" in plan
    assert S.low_pass_sparse(back, 2.0).df.count() < back.df.count()


def test_species_samples_and_the_stop_file(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    p = jobs.Parameters(n=8, niter_todo=2, niter_out=2, nparticles=4, species=((2, 1),), sample=True, histogram_bins=8, max_velocity=5.0, max_vorticity=20.0)
    assert jobs.Simulation(spark, path, p).run() == 2
    rows = spark.read.parquet(f"{path}/particles").filter("iteration = 2").groupBy("species").count().collect()
    assert {(r["species"], r["count"]) for r in rows} == {(0, 4), (1, 4)}
    for species in (0, 1):
        for quantity in ("velocity", "acceleration"):
            assert io.read_samples(spark, f"{path}/samples/species={species}", quantity).filter("step < 2").count() == 8
    h = spark.read.parquet(f"{path}/statistics/velocity_histogram")
    assert h.filter("snapshot = 0 and component = 'm'").agg(F.sum("cnt")).first()[0] == 512
    (tmp_path / "run" / "stop").touch()
    assert jobs.Simulation(spark, path, p).run() == 3


def test_command_line(spark, tmp_path, capsys):
    from fieldlake.__main__ import main, parameters, parser

    p = parameters(parser().parse_args(["simulate", "x", "-n", "16", "--forcing", "none", "--species", "2", "1", "--species", "3", "2", "--every-output", "4"]))
    assert p.grid.nx == 16 and p.forcing == {"kind": "none"} and p.species == ((2, 1), (3, 2)) and (p.niter_todo, p.niter_out) == (8, 4)
    at = f"file://{tmp_path}"
    io.write_field(G.abc_modes(spark, Grid(8, 8, 8), 1.0, 0.7, 0.5), f"{at}/w", "vorticity")
    main(["fields", f"{at}/w", f"{at}/u", "-n", "8"])
    main(["convert", f"{at}/w", f"{at}/c", "-n", "8", "--quantities", "velocity", "enstrophy"])
    main(["resize", f"{at}/w", f"{at}/r", "-n", "8", "--target", "16"])
    main(["filter-test", f"{at}/f", "-n", "8"])
    u = io.read_field(spark, f"{at}/u", "velocity", Grid(8, 8, 8), "real")
    io.write_binary(u, f"{at}/native.bin")
    main(["native", f"{at}/t", "-n", "8", "--file", "3", f"{at}/native.bin", "--name", "velocity"])
    assert u.df.count() == spark.read.parquet(f"{at}/c/velocity").count() == io.read_field(spark, f"{at}/t", "velocity", Grid(8, 8, 8), "real", [3]).df.count() == 512
    assert io.read_field(spark, f"{at}/r", "vorticity", Grid(16, 16, 16), "complex").df.count() == 16 * 16 * 9 and spark.read.parquet(f"{at}/f").count() == 9 * 512
