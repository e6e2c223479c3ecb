import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlake.functions.grid import Grid
from fieldlake.model import RealField, SpectralField
from fieldlake.operators import dynamics as W
from fieldlake.operators import generate as G
from fieldlake.operators import particles as P
from fieldlake.operators import spectral as S
from fieldlake.operators import stats as A
from fieldlake.operators import transform as T
from fieldlake.sources import io


def amplitudes(f, c=0):
    g = f.grid
    out = np.zeros((g.nz, g.ny, g.nx // 2 + 1), complex)
    for r in f.df.toPandas().to_dict("records"):
        out[r["kz"] % g.nz, r["ky"] % g.ny, r["kx"]] = r[f"re{c}"] + 1j * r[f"im{c}"]
    return out


def field(spark, grid, c=1, seed=0):
    a = np.random.default_rng(seed).normal(size=(grid.nz, grid.ny, grid.nx, c))
    rows = [(0, z, y, x, *map(float, a[z, y, x])) for z in range(grid.nz) for y in range(grid.ny) for x in range(grid.nx)]
    names = ", ".join(f"v{k} double" for k in range(c))
    return RealField(spark.createDataFrame(rows, f"snapshot long, iz int, iy int, ix int, {names}"), grid, c), a


@pytest.fixture(scope="module")
def random_field(spark):
    return field(spark, Grid(6, 4, 8))


def test_transforms_against_numpy(spark, random_field):
    f, a = random_field
    expected = np.fft.rfftn(a[..., 0])
    s = T.dft(f)
    np.testing.assert_allclose(amplitudes(s), expected, atol=1e-10)
    np.testing.assert_allclose(amplitudes(T.dft_sums(f)), expected, atol=1e-10)
    np.testing.assert_allclose(io.dense(T.normalize(T.ift(s))), a[..., 0], atol=1e-12)


def test_wrong_space_is_an_error(random_field):
    with pytest.raises(TypeError):
        T.ift(random_field[0])
    with pytest.raises(TypeError):
        S.divergence_free(T.dft(random_field[0]))
    with pytest.raises(ValueError):
        S.filter_at(T.dft(random_field[0]), 2, "unknown")


def test_projection_and_curl(spark):
    g = Grid(8, 8, 8)
    w = S.divergence_free(G.random_scalar(spark, g, components=3))
    div = w.map(tuple(sum((g.wave(a) * F.col(f"{p}{c}") for c, a in enumerate("xyz")), F.lit(0.0)) for p in ("re", "im")))
    assert abs(amplitudes(div)).max() < 1e-12
    again = S.curl(S.invert_curl(w))
    inside = S.low_pass(w, g.km + 1e-9)
    for c in range(3):
        np.testing.assert_allclose(amplitudes(again, c), amplitudes(inside, c), atol=1e-12)


def test_spectrum_is_the_mean_square(spark):
    g = Grid(8, 8, 8)
    w = S.low_pass(G.random_scalar(spark, g, components=3), g.km)
    total = A.autocorrelation(w).first()["value"]
    means = A.moments(T.ift(w)).filter("component = 'm'").first()["m2"]
    assert total == pytest.approx(means)


def test_random_fields_are_hermitian_and_repeatable(spark):
    f = G.random_scalar(spark, Grid(8, 8, 8))
    a, b = amplitudes(f), amplitudes(S.symmetrize(f))
    np.testing.assert_array_equal(a, b)
    np.testing.assert_allclose(amplitudes(T.normalize(T.dft(T.ift(f)))), a, atol=1e-12)


def test_step_converges(spark):
    g = Grid(8, 8, 8)
    w = S.divergence_free(G.random_scalar(spark, g, slope=1.0, amplitude=1.0, components=3))

    def run(n):
        flow, v = W.Flow(viscosity=0.05, dt=0.2 / n, forcing={"kind": "none"}), w
        for _ in range(n):
            v = W.step(v, flow)
        return amplitudes(v)

    one, two, four = run(1), run(2), run(4)
    assert np.abs(two - four).max() < np.abs(one - two).max() / 4 + 1e-12


def test_resize_there_and_back(spark):
    f = G.random_scalar(spark, Grid(6, 6, 6))
    np.testing.assert_allclose(amplitudes(S.resize(S.resize(f, Grid(12, 12, 12)), Grid(6, 6, 6))), amplitudes(f))


def test_samples_of_a_smooth_flow(spark):
    g = Grid(16, 16, 16)
    u = G.abc_flow(spark, g, 1.0, 0.7, 0.5)
    p = G.tracers(spark, 200).select("particle", "x", "y", "z")
    got = P.sample(p, u, 3, 2).toPandas()
    np.testing.assert_allclose(got.s0, np.sin(got.z) + 0.5 * np.cos(got.y), atol=2e-4)
    slope = P.sample(p, u, 3, 2, (0, 0, 1)).toPandas()
    np.testing.assert_allclose(slope.s0, np.cos(slope.z), atol=5e-3)


def test_equal_particles_stay_apart(spark):
    g = Grid(8, 8, 8)
    p = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0), (2, -9.0, 20.0, 0.0)], "particle long, x double, y double, z double")
    got = P.sample(p, G.abc_flow(spark, g), 1, 1).toPandas()
    assert len(got) == 3 and got.s0[got.particle == 1].nunique() == 1


def test_checkpoints_replace_and_roll(spark, tmp_path):
    g = Grid(4, 4, 4)
    c = io.Checkpoints(spark, f"file://{tmp_path}/c", g, per_file=2)
    w = G.random_scalar(spark, g, components=3)
    assert [c.write(w, k) for k in (0, 1, 1, 2)] == [0, 0, 0, 1]
    assert c.last() == 2 and c.union().select("snapshot").distinct().count() == 3
    assert c.read(2).df.count() == w.df.count()
    with pytest.raises(KeyError):
        c.read(9)


def test_binary_spectral_and_real(spark, tmp_path):
    f, a = field(spark, Grid(6, 4, 2), 3, 5)
    path = f"{tmp_path}/native"
    io.write_binary(f, path, "single")
    np.testing.assert_allclose(np.fromfile(path, "f4").reshape(a.shape), a, rtol=1e-6)
    np.testing.assert_allclose(io.dense(io.read_binary(spark, path, f.grid, 3, precision="single")), a, rtol=1e-6)
    s = np.fft.rfftn(a[..., 0]).transpose(1, 0, 2)
    s.astype(complex).tofile(f"{tmp_path}/modes")
    np.testing.assert_allclose(amplitudes(io.read_binary(spark, f"{tmp_path}/modes", f.grid, 1, space="complex")), np.fft.rfftn(a[..., 0]), atol=1e-12)


def whole_spectrum(n):
    """Wavenumbers (x, y, z) of the whole spectrum, their squares, the same without 0, and transforms of (3, z, y, x) arrays."""
    k1 = np.fft.fftfreq(n, 1 / n)
    k1[n // 2] = n // 2
    kz, ky, kx = np.meshgrid(k1, k1, k1, indexing="ij")
    k2 = kx**2 + ky**2 + kz**2
    return np.stack([kx, ky, kz]), k2, np.where(k2 > 0, k2, 1), lambda f: np.real(np.fft.ifftn(f, axes=(1, 2, 3)) * n**3), lambda f: np.fft.fftn(f, axes=(1, 2, 3)) / n**3


def test_nonlinear_term_and_step_against_numpy(spark):
    """A Taylor-Green vortex, whose nonlinear term doesn't vanish."""
    n, nu, dt = 16, 0.05, 0.02
    g = Grid(n, n, n, dealias="two_thirds")
    x = np.arange(n) * 2 * np.pi / n
    z, y, xx = np.meshgrid(x, x, x, indexing="ij")
    velocity = np.stack([np.sin(xx) * np.cos(y) * np.cos(z), -np.cos(xx) * np.sin(y) * np.cos(z), np.zeros_like(z)])
    k, k2, safe, real, spec = whole_spectrum(n)
    curl = lambda f: 1j * np.cross(k, f, axis=0)
    w0 = curl(spec(velocity))
    half = w0[:, :, :, : n // 2 + 1]
    rows = []
    signed = lambda i: i if i <= n // 2 else i - n
    for iz in range(n):
        for iy in range(n):
            for ix in range(n // 2 + 1):
                a = half[:, iz, iy, ix]
                rows.append((0, signed(iy), signed(iz), ix, *(float(v) for c in a for v in (c.real, c.imag))))
    w = SpectralField(spark.createDataFrame(rows, "snapshot long, ky int, kz int, kx int, re0 double, im0 double, re1 double, im1 double, re2 double, im2 double").repartition(4), g, 3)

    def array(f):
        out = np.zeros((3, n, n, n // 2 + 1), complex)
        for r in f.df.collect():
            out[:, r["kz"] % n, r["ky"] % n, r["kx"]] = [complex(r[f"re{c}"], r[f"im{c}"]) for c in range(3)]
        return out

    def rhs(w):
        u = 1j * np.cross(k, w, axis=0) / safe
        return curl(spec(np.cross(real(u), real(w), axis=0)))

    got = array(W.nonlinear(w, {"kind": "none"}))
    want = rhs(w0)
    low = (k2 <= (n / 3 - 1) ** 2)[:, :, : n // 2 + 1]
    assert np.abs(want).max() > 0.01 and np.allclose(got[:, low], want[:, :, :, : n // 2 + 1][:, low], atol=1e-12)
    decay = lambda s: np.exp(-nu * k2 * s)
    v1 = (w0 + dt * rhs(w0)) * decay(dt)
    v2 = 0.25 * (3 * w0 * decay(dt / 2) + (v1 + dt * rhs(v1)) * decay(-dt / 2))
    v3 = (w0 * decay(dt / 2) + 2 * (v2 + dt * rhs(v2))) * decay(dt / 2) / 3
    stepped = array(W.step(w, W.Flow(nu, dt, {"kind": "none"})))
    lower = (k2 <= (n / 6) ** 2)[:, :, : n // 2 + 1]
    assert np.allclose(stepped[:, lower], v3[:, :, :, : n // 2 + 1][:, lower], atol=1e-8)
    assert np.abs(v3 - w0 * decay(dt)).max() > 1e-4  # more than viscosity


def test_native_files_of_both_spaces(spark, tmp_path):
    g = Grid(4, 6, 8)
    w = G.random_scalar(spark, g, components=3)
    for f, space in ((w, "complex"), (T.ift(w), "real")):
        io.write_binary(f, f"file://{tmp_path}/{space}.bin")
        back = io.read_binary(spark, f"file://{tmp_path}/{space}.bin", g, 3, space=space)
        keys = ["snapshot", "ky", "kz", "kx"] if space == "complex" else ["snapshot", "iz", "iy", "ix"]
        rows = lambda x: sorted(tuple(r) for r in x.df.select(*keys, *x.values).collect())
        assert rows(back) == rows(f)


def test_checkpoint_index_names_what_is_there(spark, tmp_path):
    g = Grid(4, 4, 4)
    w = G.random_scalar(spark, g, components=3)
    c = io.Checkpoints(spark, f"file://{tmp_path}/c", g, per_file=2)
    three = w.with_df(w.df.withColumn("snapshot", F.explode(F.array(*[F.lit(k).cast("long") for k in (3, 5, 9)]))))
    assert c.write_all(three) == {3: 0, 5: 0, 9: 1} and c.write(w, 11) == 1 and c.write(w, 5) == 0 and c.last() == 11
    assert c.union().groupBy("snapshot").count().count() == 4 and c.read(9).df.count() == w.df.count()


def series(spark, count, n=4):
    """Snapshots 0.. of a constant field each, whose value is the number."""
    df = spark.range(count).select(F.col("id").alias("snapshot"), F.explode(F.sequence(F.lit(0), F.lit(n**3 - 1))).alias("p"), F.col("id").cast("double").alias("v0"))
    return RealField(df.select("snapshot", (F.col("p") / n**2).cast("int").alias("iz"), (F.col("p") / n % n).cast("int").alias("iy"), (F.col("p") % n).alias("ix"), "v0").repartition(6), Grid(n, n, n))


def files_under(path, pattern="*.parquet"):
    return len(list(path.rglob(pattern)))


def test_a_long_series_is_few_files(spark, tmp_path):
    f, at = series(spark, 300), f"file://{tmp_path}/s"
    io.write_field(f, at, "v")
    assert files_under(tmp_path / "s") <= 8
    back = io.read_field(spark, at, "v", f.grid, "real", [3, 5, 299, 300])
    assert sorted(tuple(r) for r in back.df.groupBy("snapshot").agg(F.count("*"), F.max("v0"), F.min("v0")).collect()) == [(k, 64, k, k) for k in (3, 5, 299)]


def test_snapshots_choose_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "FOLDER_BYTES", 8 * 64 * 16)  # 16 snapshots a folder
    f, at = series(spark, 100), f"file://{tmp_path}/s"
    io.write_field(f, at, "v")
    back = io.read_field(spark, at, "v", f.grid, "real", [17])
    plan = back.df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [exists(" in plan and len(list((tmp_path / "s").rglob("last=*"))) == 7
    assert back.df.count() == 64


def test_series_grow_and_are_replaced_in_shared_folders(spark, tmp_path):
    f, at = series(spark, 200), f"file://{tmp_path}/s"
    for odd in (1, 0):
        io.write_field(f.with_df(f.df.filter(F.col("snapshot") % 2 == odd)), at, "v")
    assert files_under(tmp_path / "s") <= 16
    io.write_field(f.with_df(f.df.filter("snapshot in (7, 8)").withColumn("v0", F.lit(-1.0))), at, "v", "overwrite")
    rows = io.read_field(spark, at, "v", f.grid, "real").df.groupBy("snapshot").agg(F.count("*"), F.min("v0"), F.max("v0")).collect()
    assert sorted(map(tuple, rows)) == [(k, 64, v, v) for k in range(200) for v in [-1 if k in (7, 8) else k]]
    with pytest.raises(ValueError):
        io.write_field(series(spark, 2, 8), at, "v", "overwrite")


def test_whole_snapshots_are_written_as_arrays(spark, tmp_path, monkeypatch):
    """The shuffle and the sort of a written series have planes as arrays, not points; short and missing values stay out."""
    from fieldlake.plans import views as V

    monkeypatch.setattr(io, "FOLDER_BYTES", 8 * 64 * 3 * 16)  # 16 snapshots a folder
    rng = np.random.default_rng(2)
    e = [(k, [float(x) for x in rng.normal(size=64).round(3)]) for k in range(120)] + [(k, [None, *[1.0] * 40]) for k in (120, 121, 122)]
    spark.createDataFrame(e, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    v, at, plans = V.vec3d(spark, str(tmp_path)), f"file://{tmp_path}/s", []
    kept = io.points
    monkeypatch.setattr(io, "points", lambda rows, *more: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or kept(rows, *more))
    for odd in (1, 0):
        io.write_field(v.of_snapshots(F.col("snapshot") % 2 == odd), at, "v")
    assert len(plans) == 2 and all("Sort" in p and "RepartitionByExpression" in p for p in plans)
    back = io.read_field(spark, at, "v", v.grid, "real")
    assert back.df.count() == 40 * 64 + 40 and sorted(map(tuple, back.df.collect())) == sorted(map(tuple, v.df.select(*back.df.columns).collect()))
    assert back.df.schema == io.read_field(spark, at, "v", v.grid, "real", [3]).df.schema and len(list((tmp_path / "s").rglob("last=*"))) == 3
    assert all(len(io.read_field(spark, at, "v", v.grid, "real", [k]).df.inputFiles()) <= 8 for k in (0, 40))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_planes_and_lines_of_a_long_series(spark, tmp_path):
    f, at = series(spark, 250), f"file://{tmp_path}/s"
    io.write_field(f, at, "v")
    back = io.read_field(spark, at, "v", f.grid, "real")
    for part, n in ((io.zslice(back), 16), (io.xline(back), 4)):
        assert "PushedFilters: [IsNotNull(iz)" in part.df._jdf.queryExecution().executedPlan().toString()
        assert len(part.df.inputFiles()) <= 8 and part.df.count() == 250 * n


def test_many_checkpoints_are_one_job(spark, tmp_path):
    g = Grid(4, 4, 4)
    w = G.random_scalar(spark, g, components=3)
    w = w.with_df(w.df.drop("snapshot").crossJoin(spark.range(200).withColumnRenamed("id", "snapshot")))
    c = io.Checkpoints(spark, f"file://{tmp_path}/c", g, per_file=20)
    assert c.write_all(w) == {k: k // 20 for k in range(200)}
    assert files_under(tmp_path / "c" / "vorticity") <= 10 * 4
    assert c.write(w.with_df(w.df.filter("snapshot = 0")), 33) == 1
    rows = c.union().groupBy("snapshot").count().collect()
    assert sorted(r["snapshot"] for r in rows) == list(range(200)) and {r["count"] for r in rows} == {48}
    assert c.read(34).df.count() == 48


def test_many_native_files_by_tasks(spark, tmp_path):
    f = series(spark, 120)
    (tmp_path / "n s").mkdir()
    (tmp_path / "n s" / "other").write_bytes(bytes(64 * 8))
    (tmp_path / "n s" / ".f007.crc").write_bytes(b"stale")
    name = lambda k: f"file://{tmp_path}/n s/f{k:03x}"
    assert io.write_binary(f, name) == list(range(120))
    np.testing.assert_array_equal(np.fromfile(tmp_path / "n s" / "f04d"), np.full(64, 77.0))
    assert sorted(x.name for x in (tmp_path / "n s").iterdir()) == sorted([*(f"f{k:03x}" for k in range(120)), "other"])
    back = io.read_binaries(spark, {k: name(k) for k in range(120)}, f.grid, 1)
    assert back.df.rdd.getNumPartitions() <= 16
    assert sorted(map(tuple, back.df.groupBy("snapshot").agg(F.count_distinct("iz", "iy", "ix"), F.min("v0"), F.max("v0")).collect())) == [(k, 64, k, k) for k in range(120)]
    with pytest.raises(ValueError):
        io.write_binary(f, f"file://{tmp_path}/one")
    (tmp_path / "n s" / "f003").write_bytes(bytes(24))
    with pytest.raises(ValueError):
        io.read_binaries(spark, {k: name(k) for k in range(120)}, f.grid, 1)


def test_planes_over_batches_and_large_native_files(spark, tmp_path, monkeypatch):
    """Planes of more rows than a batch, and files that are read by ranges."""
    monkeypatch.setattr(io, "WHOLE_BYTES", 0)
    f, a = field(spark, Grid(16, 12, 5), 3, 9)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        io.write_binary(f, f"{tmp_path}/a")
        np.testing.assert_array_equal(np.fromfile(tmp_path / "a").reshape(a.shape), a)
        two = io.read_binaries(spark, {4: f"{tmp_path}/a", 9: f"{tmp_path}/a"}, f.grid, 3)
        for k in (4, 9):
            np.testing.assert_array_equal(io.dense(two.with_df(two.df.filter(F.col("snapshot") == k))), a)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_embeddings_meet_whole(spark, tmp_path):
    """Before the shuffle nothing is exploded; several embeddings of one number, nulls and short ones give what SQL gives."""
    import duckdb

    from fieldlake.plans import views as V

    rng = np.random.default_rng(1)
    e = [(k, [float(x) for x in rng.normal(size=64).round(3)]) for k in [*range(12), 4, 4, 20, 21]]
    e += [(12, [1.0] * 64), (13, None), (14, [2.0] * 64), (15, [None, *[1.0] * 63]), (16, [1.0] * 40), (17, [3.0] * 64), (17, [4.0] * 10), (None, [1.0] * 64)]
    spark.createDataFrame(e, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    v = V.vec3d(spark, str(tmp_path))
    want = duckdb.sql(f"WITH embeddings AS (SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'), {V.VEC} SELECT * FROM vec ORDER BY ALL").fetchall()
    assert len(want) == 4 * 64 + 39 and sorted(map(tuple, v.df.collect())) == want
    plan = v.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan[: plan.index("Aggregate")] and "Generate" not in plan[plan.index("Aggregate") :]


def test_small_snapshots_are_transformed_whole(spark, monkeypatch):
    f, _ = field(spark, Grid(6, 4, 5), 2, 3)
    found = []
    for limit in (T.SMALL_BYTES, 0):
        monkeypatch.setattr(T, "SMALL_BYTES", limit)
        w = T.dft(f)
        plan = w.df._jdf.queryExecution().optimizedPlan().toString()
        found.append((plan.count("MapInPandas"), sorted(map(tuple, w.df.collect())), sorted(map(tuple, T.ift(w).df.collect()))))
    assert [n for n, *_ in found] == [1, 2]
    np.testing.assert_allclose(np.array(found[0][1]), np.array(found[1][1]), atol=1e-13)
    np.testing.assert_allclose(np.array(found[0][2]), np.array(found[1][2]), atol=1e-12)


def test_checkpoints_make_their_field_once(spark, tmp_path):
    w, seen = G.random_scalar(spark, Grid(4, 4, 4), components=3), spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    c = io.Checkpoints(spark, f"file://{tmp_path}/c", w.grid, per_file=2)
    c.write_all(w.with_df(w.df.mapInArrow(count, w.df.schema)))
    assert seen.value == c.union().count() == 48


def test_small_native_files_are_opened_by_tasks(spark, tmp_path):
    f = series(spark, 30)
    name = lambda k: f"file://{tmp_path}/n/f{k:03x}"
    io.write_binary(f, name)
    back = io.read_binaries(spark, {**{k: name(k) for k in range(30)}, 77: name(5)}, f.grid, 1)
    assert "binaryFile" not in back.df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, back.df.groupBy("snapshot").agg(F.count("*"), F.min("v0"), F.max("v0")).collect())) == [(k, 64, k % 72, k % 72) for k in [*range(30), 77]]
    (tmp_path / "n" / "f003").unlink()
    with pytest.raises(ValueError):
        io.read_binaries(spark, {3: name(3)}, f.grid, 1)


def test_xlines_are_a_series_of_their_own(spark, tmp_path, monkeypatch):
    """Only the lines' values are brought together and stored, with what SQL gives; lines of points give the same."""
    import duckdb

    from fieldlake.plans import motion
    from fieldlake.plans import views as V

    rng = np.random.default_rng(6)
    e = [(k, [float(x) for x in rng.normal(size=64).round(3)]) for k in [*range(90), 4, 4, 95]]
    e += [(96, [1.0] * 64), (97, None), (98, [2.0] * 64), (99, [None, 5.0]), (100, [1.0] * 40), (101, [3.0] * 64), (101, [4.0] * 3), (102, []), (103, [1.0]), (104, [1.0]), (None, [1.0] * 64)]
    spark.createDataFrame(e, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = motion.SQL["s4_xline"].replace("WITH ", f"WITH embeddings AS (SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'), ", 1)
    want = duckdb.sql(f"{sql} ORDER BY ALL").fetchall()
    v, at = V.vec3d(spark, str(tmp_path)), f"file://{tmp_path}/s"
    plan = io.xline(v).whole._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in plan[plan.index("Aggregate") :]
    for odd in (1, 0):
        io.append_xlines(v.of_snapshots(F.col("snapshot") % 2 == odd), at, "v")
    back = io.read_xlines(spark, at, "v", v.grid, components=3)
    rows = lambda f: sorted(map(tuple, f.df.selectExpr("snapshot", "iz", "iy", "ix", *[f"round(v{c}, 6) + 0.0D" for c in range(3)]).collect()))
    assert len(want) == 30 * 4 + 1 and rows(back) == want and back.grid == Grid(4)
    assert rows(io.read_xlines(spark, at, "v", v.grid, [3])) == [x for x in want if x[0] == 3]
    io.append_xlines(v.with_df(v.df), at, "points")
    assert rows(io.read_xlines(spark, at, "points", v.grid)) == want
    monkeypatch.setattr(motion, "new_path", lambda s, name: f"file://{tmp_path}/q")
    assert motion.QUERIES["s4_xline"](spark, str(tmp_path)).count() == sum(spark.read.parquet(str(p)).count() for p in (tmp_path / "q").rglob("real")) == len(want)
