"""Snapshots, checkpoints, samples, binary arrays and parameters.

Fields and samples are Parquet tables partitioned by what their readers ask for, so that a
snapshot or a quantity is a partition filter; growing a series is appending to it.  Small
snapshots share folders, by ranges of their numbers, so that a long series isn't as many files.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.functions.grid import Grid, shell_table
from fieldlake.model import MODE, POINT, RealField, SpectralField, points
from fieldlake.operators.spectral import divergence_free, low_pass, symmetrize
from fieldlake.sources.shared import drop_written, written


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_parameters(spark: SparkSession, path: str, parameters: dict) -> None:
    """Typed names and values: strings, numbers and lists of them; replaces what is there."""
    rows = [(k, json.dumps(v)) for k, v in sorted(parameters.items())]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(path)


def read_parameters(spark: SparkSession, path: str) -> dict:
    """The parameters again; a large integer stays one."""
    return {r["name"]: json.loads(r["value"]) for r in spark.read.schema("name string, value string").json(path).collect()}


#: Bytes of values that share a folder.
FOLDER_BYTES = 2**24


def _span(field: RealField | SpectralField) -> int:
    """How many numbers of snapshots share a folder: a power of two; one where a snapshot fills it."""
    g = field.grid
    fast = g.nx if isinstance(field, RealField) else g.nx // 2 + 1
    return 1 << max(0, (FOLDER_BYTES // (8 * g.nz * g.ny * fast * len(field.values))).bit_length() - 1)


def _ranged(field: RealField | SpectralField, df: DataFrame | None = None) -> DataFrame:
    """The rows, or those of ``df``, with the first and last number of their folder."""
    span, df = _span(field), (field.df if df is None else df).withColumn("snapshot", F.col("snapshot").cast("long"))
    first = F.col("snapshot") - F.pmod(F.col("snapshot"), F.lit(span))
    return df.withColumn("first", first).withColumn("last", F.col("first") + (span - 1))


def _put(rows: DataFrame, at: str, folders: list[str], slow: str | None, span: int, mode: str) -> None:
    """Writes rows into their folders; ``overwrite`` replaces the snapshots written and keeps what else their folders hold."""
    spark, fresh = rows.sparkSession, None
    if mode == "overwrite" and _exists(spark, at):
        stored = spark.read.schema(rows.schema).parquet(at)
        if not stored.filter(F.coalesce(F.col("last") - F.col("first") != span - 1, F.lit(True))).isEmpty():
            raise ValueError(f"{at} holds fields of another size")
        if span > 1:
            fresh = rows = written(rows, "fresh")
            kept = stored.join(fresh.select(*folders).distinct(), folders, "left_semi").join(fresh.select("snapshot").distinct(), "snapshot", "left_anti")
            rows = rows.unionByName(kept)
    if span > 1:  # a folder's files are few, and each is in the order of snapshots
        rows = rows.repartition(*folders, *([slow] if slow else [])).sortWithinPartitions(*folders, "snapshot")
    out = rows.write.partitionBy(*folders).mode(mode)
    if mode == "overwrite":
        out = out.option("partitionOverwriteMode", "dynamic")
    out.parquet(at)
    if fresh is not None:
        drop_written(fresh)


#: Files of a full folder at least, which are written and read side by side.
FOLDER_FILES = 4
#: Files that a task has open at once where its rows come in order anyhow; of more, Spark sorts the rest.
OPEN_FILES = 16


def _append_whole(field: RealField, at: str) -> None:
    """Appends whole snapshots: planes are brought together and put in order as arrays, and become points as they are written."""
    g, values, spark = field.grid, field.values, field.df.sparkSession
    size, folders = g.ny * g.nx, ["first", "last"]
    plane = F.transform(F.sequence(F.lit(0), F.lit(g.nz - 1)), lambda z: F.struct(*[F.slice(v, z * size + 1, size).alias(v) for v in values]))
    rows = _ranged(field, field.whole.select("snapshot", F.posexplode(plane).alias("iz", "plane"))).select("snapshot", "iz", *[F.col("plane")[v].alias(v) for v in values], *folders)
    part = F.floor((F.col("snapshot") - F.col("first")) * -(-FOLDER_FILES // g.nz) / _span(field))
    rows = rows.repartition(*folders, "iz", part).sortWithinPartitions(*folders, "snapshot")
    rows = points(rows, ["snapshot", "iz", *folders], values)
    rows = rows.select("snapshot", "iz", (F.col("p") / g.nx).cast("int").alias("iy"), (F.col("p") % g.nx).alias("ix"), *values, *folders)
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, OPEN_FILES)  # else the points are sorted once more
    try:
        rows.write.partitionBy(*folders).mode("append").parquet(at)
    finally:
        spark.conf.set(key, before)


def write_field(field: RealField | SpectralField, path: str, name: str, mode: str = "append") -> None:
    """Snapshots of a quantity, in either representation; ``overwrite`` replaces the snapshots written."""
    space, slow = ("real", "iz") if isinstance(field, RealField) else ("complex", "ky")
    if mode == "append" and space == "real" and field.whole is not None and _span(field) > 1:
        return _append_whole(field, f"{path}/{name}/{space}")
    _put(_ranged(field), f"{path}/{name}/{space}", ["first", "last"], slow, _span(field), mode)


def read_field(spark: SparkSession, path: str, name: str, grid: Grid, space: str, snapshots: list[int] | None = None, components: int | None = None) -> RealField | SpectralField:
    """The quantity's snapshots; complex fields are made Hermitian again."""
    if space not in ("real", "complex"):
        raise ValueError("space is real or complex")
    df = spark.read.parquet(f"{path}/{name}/{space}").withColumn("snapshot", F.col("snapshot").cast("long"))
    if snapshots is not None:
        df = df.filter(F.col("snapshot").isin(snapshots))
        if snapshots and "first" in df.columns:
            df = df.filter(F.exists(F.array(*[F.lit(int(k)).cast("long") for k in snapshots]), lambda k: (k >= F.col("first")) & (k <= F.col("last"))))
    first, keys = ("v", POINT) if space == "real" else ("re", MODE)
    n = sum(c.startswith(first) and c[len(first) :].isdigit() for c in df.columns)
    if components is not None and n != components:
        raise TypeError(f"{name} has {n} components, not {components}")
    if space == "real":
        return RealField(df.select(*keys, *[f"v{k}" for k in range(n)]), grid, n)
    return symmetrize(SpectralField(df.select(*keys, *[f"{p}{k}" for k in range(n) for p in ("re", "im")]), grid, n))


def zslice(field: RealField, iz: int = 0) -> RealField:
    """A plane of constant z; the filter reaches the scan."""
    return field.with_df(field.df.filter(F.col("iz") == iz))


def xline(field: RealField) -> RealField:
    """The first line along x, a field on that line."""
    grid = replace(field.grid, ny=1, nz=1)
    if field.line is None:
        return replace(field.with_df(field.df.filter((F.col("iz") == 0) & (F.col("iy") == 0))), grid=grid)
    rows = points(field.line, ["snapshot"], field.values)
    return RealField(rows.select("snapshot", F.lit(0).alias("iz"), F.lit(0).alias("iy"), F.col("p").alias("ix"), *field.values), grid, field.components, field.line)


def append_xlines(field: RealField, path: str, name: str) -> None:
    """Appends the first line along x of every snapshot to the quantity's series of lines; the rest of the field isn't stored."""
    write_field(xline(field), path, f"xlines/{name}")


def read_xlines(spark: SparkSession, path: str, name: str, grid: Grid, snapshots: list[int] | None = None, components: int | None = None) -> RealField:
    """The series of lines again; ``grid`` is that of the field."""
    return read_field(spark, path, f"xlines/{name}", replace(grid, ny=1, nz=1), "real", snapshots, components)


def clean_vorticity(w: SpectralField) -> SpectralField:
    """What a stored vorticity goes through when it is read: low pass, no divergence, symmetry."""
    return symmetrize(divergence_free(low_pass(w, w.grid.km)))


class Checkpoints:
    """Snapshots of the vorticity in numbered files of so many snapshots each: sub-tables of one table of a field."""

    def __init__(self, spark: SparkSession, path: str, grid: Grid, per_file: int = 1):
        self.spark, self.path, self.grid, self.per_file = spark, path, grid, per_file
        self.at = f"{path}/vorticity/complex"

    def _known(self) -> list[tuple[int, int]]:
        index = f"{self.path}/index"
        if not _exists(self.spark, index):
            return []
        return [(r["file"], r["snapshot"]) for r in self.spark.read.parquet(index).distinct().collect()]

    def write(self, w: SpectralField, snapshot: int) -> int:
        """The file's number; a snapshot that is there already is replaced where it stands."""
        return self._write(w.with_df(w.df.withColumn("snapshot", F.lit(snapshot).cast("long"))), [snapshot])[snapshot]

    def write_all(self, w: SpectralField) -> dict[int, int]:
        """Every snapshot of ``w``, all files by one job; the files' numbers by snapshot."""
        w = w.with_df(fresh := written(w.df, "checkpoints"))  # what made the field is done once
        try:
            return self._write(w, sorted(r[0] for r in fresh.select("snapshot").distinct().collect()))  # one number for each checkpoint
        finally:
            drop_written(fresh)

    def _write(self, w: SpectralField, snapshots: list[int]) -> dict[int, int]:
        known = self._known()
        placed, sizes = {s: f for f, s in known}, Counter(f for f, _ in known)
        file, files = max(sizes, default=0), {}
        for s in snapshots:
            if s not in placed:
                if sizes[file] >= self.per_file:
                    file += 1
                sizes[file] += 1
            files[s] = placed.get(s, file)
        own = self.spark.createDataFrame(pa.table({"snapshot": pa.array(files.keys(), pa.int64()), "file": pa.array(files.values(), pa.int32())}))  # one row for each checkpoint
        slow = "ky" if 4 * self.per_file >= _span(w) else None  # files of few snapshots aren't cut further
        _put(_ranged(w).join(F.broadcast(own), "snapshot"), self.at, ["file", "first", "last"], slow, _span(w), "overwrite")
        new = [(files[s], s) for s in snapshots if s not in placed]
        if new:  # after the data: what the index names is there
            table = pa.table({"file": pa.array([f for f, _ in new], pa.int32()), "snapshot": pa.array([s for _, s in new], pa.int64())})
            self.spark.createDataFrame(table).coalesce(1).write.mode("append").parquet(f"{self.path}/index")
        return files

    def last(self) -> int | None:
        return max((s for _, s in self._known()), default=None)

    def read(self, snapshot: int) -> SpectralField:
        file = next((f for f, s in self._known() if s == snapshot), None)
        if file is None:
            raise KeyError(f"no snapshot {snapshot}")
        rows = self.spark.read.parquet(self.at).filter((F.col("file") == file) & (F.col("first") <= snapshot) & (F.col("last") >= snapshot) & (F.col("snapshot") == snapshot))
        w = SpectralField(rows.select(*MODE, *[f"{p}{k}" for k in range(3) for p in ("re", "im")]), self.grid, 3)
        return divergence_free(low_pass(symmetrize(w), self.grid.km))

    def union(self) -> DataFrame:
        """All snapshots of all files as one table; nothing is copied."""
        known = sorted(set(self._known()))
        if not known:
            raise KeyError("no snapshots")
        index = self.spark.createDataFrame(pa.table({"file": pa.array([f for f, _ in known], pa.int32()), "snapshot": pa.array([s for _, s in known], pa.int64())}))  # one row for each checkpoint
        return self.spark.read.parquet(self.at).join(F.broadcast(index), ["file", "snapshot"], "left_semi").drop("file", "first", "last")


def append_samples(samples: DataFrame, path: str, quantity: str) -> int:
    """Appends (step, ...) rows of a quantity, but for steps that are there already; how many steps were new."""
    spark = samples.sparkSession
    at = f"{path}/quantity={quantity}"
    new = samples
    if _exists(spark, at):
        new = samples.join(spark.read.parquet(at).select(F.col("step").cast("long").alias("step")).distinct(), "step", "left_anti")
    steps = new.select("step").distinct().count()
    if steps:
        new.write.partitionBy("step").mode("append").parquet(at)
    return steps


def read_samples(spark: SparkSession, path: str, quantity: str) -> DataFrame:
    return spark.read.parquet(f"{path}/quantity={quantity}").withColumn("step", F.col("step").cast("long"))


def write_particles(particles: DataFrame, path: str) -> None:
    """State and right-hand sides of a step, appended."""
    particles.write.partitionBy("species", "step").mode("append").parquet(path)


def read_particles(spark: SparkSession, path: str, step: int | None = None) -> DataFrame:
    df = spark.read.parquet(path).withColumn("step", F.col("step").cast("long"))
    return df if step is None else df.filter(F.col("step") == step)


def store_shells(grid: Grid, spark: SparkSession, path: str) -> None:
    """kshell and nshell, with km and dk in every row."""
    shell_table(grid, spark).withColumn("kM", F.lit(float(grid.km))).withColumn("dk", F.lit(float(grid.dk))).coalesce(1).write.mode("overwrite").parquet(path)


def append_spectrum(spectrum: DataFrame, path: str) -> None:
    spectrum.write.mode("append").parquet(path)


def binary_name(simulation: str, space: str, field: str, iteration: int) -> str:
    """Name of a native file, by simulation, representation (c or r), field and iteration in hexadecimal."""
    return f"{simulation}_{space}{field}_i{iteration:05x}"


def read_binary(spark: SparkSession, path: str, grid: Grid, components: int, snapshot: int = 0, precision: str = "double", space: str = "real") -> RealField | SpectralField:
    """A native array: (z, y, x, component) of reals, or (y, z, x/2+1, component) of complex numbers."""
    return read_binaries(spark, {snapshot: path}, grid, components, precision, space)


#: Files up to this size are read whole, many in a task; larger ones by ranges.
WHOLE_BYTES = 2**22
#: Bytes, and small files, of a task that reads them in a mounted folder.
TASK_BYTES, TASK_FILES = 2**25, 4096
#: Bytes that are unpacked or packed at once.
BATCH_BYTES = 2**23


def _lengths(spark: SparkSession, files: list[str]) -> tuple[DataFrame, dict[str, str], dict[str, int]]:
    """The files as rows of Spark's source, their names there, and their lengths by those names."""
    parents = sorted({f.rpartition("/")[0] for f in files})
    conf, full = spark._jsc.hadoopConfiguration(), {}
    for parent in parents:
        at = spark._jvm.org.apache.hadoop.fs.Path(parent or ("/" if files[0].startswith("/") else "."))
        system = at.getFileSystem(conf)
        full[parent] = system.makeQualified(at).toString().rstrip("/")
    names = {f: f"{full[f.rpartition('/')[0]]}/{f.rpartition('/')[2]}" for f in files}
    # Many files are listed by their folders.
    found = spark.read.format("binaryFile").load(sorted(set(names.values())) if len(names) <= 32 else sorted(full.values()))
    wanted = set(names.values())
    return found, names, {r["path"]: r["length"] for r in found.select("path", "length").collect() if r["path"] in wanted}  # names, which the driver has listed


def _mounted(spark: SparkSession, files: list[str]) -> bool:
    """Whether the files lie in a mounted folder, which driver and executors must share."""
    system = lambda f: spark._jvm.org.apache.hadoop.fs.Path(f).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    return all(system(f"{p}/x") == "file" for p in {f.rpartition("/")[0] for f in files})


def _local(file: str, base: str) -> str:
    return os.path.join(base, re.sub("^file:/*", "/", file))


def _read_mounted(spark: SparkSession, files: dict[int, str], size: int) -> DataFrame:
    """snapshot and raw of small files, which tasks open themselves: a source of Spark's takes some milliseconds for each."""
    base, many = os.getcwd(), max(1, min(TASK_FILES, TASK_BYTES // max(1, size)))
    names = spark.createDataFrame(pa.table({"snapshot": pa.array(files.keys(), pa.int64()), "file": pa.array(files.values(), pa.string())}))  # names, which the caller holds

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, BATCH_BYTES // max(1, size))
        for batch in batches:
            for lo in range(0, len(batch), at_once):
                part, found = batch.slice(lo, at_once), []
                for file in part.column("file").to_pylist():
                    with open(_local(file, base), "rb") as f:
                        found.append(f.read())
                    if len(found[-1]) != size:
                        raise ValueError(f"{file} has {len(found[-1])} bytes, not {size}")
                yield pa.RecordBatch.from_arrays([part.column("snapshot"), pa.array(found, pa.binary())], names=["snapshot", "raw"])

    tasks = max(-(-len(files) // many), min(len(files), spark.sparkContext.defaultParallelism))
    return names.repartition(tasks).mapInArrow(read, "snapshot long, raw binary")


def read_binaries(spark: SparkSession, files: dict[int, str], grid: Grid, components: int, precision: str = "double", space: str = "real") -> RealField | SpectralField:
    """Native arrays by snapshot, all at once.

    Small files are read whole, many in a task; larger ones by ranges, a record for each plane of
    the slowest axis, wherever their splits fall.  A file of another length is an error.
    """
    kind = {"double": "f8", "single": "f4"}[precision]
    if space == "real":
        slow, middle, fast, width = grid.nz, grid.ny, grid.nx, components
    else:
        slow, middle, fast, width = grid.ny, grid.nz, grid.nx // 2 + 1, 2 * components
    size = middle * fast * width * np.dtype(kind).itemsize
    if size >= 2**31:
        raise ValueError("a plane of 2 GB or more is no record")
    snapshots, whole = sorted(files), slow * size <= WHOLE_BYTES
    if mounted := whole and _mounted(spark, [files[k] for k in snapshots]):
        here = {f: _local(f, os.getcwd()) for f in files.values()}
        wrong = [f for f, at in here.items() if not os.path.isfile(at) or os.path.getsize(at) != slow * size]
    else:
        found, full, lengths = _lengths(spark, [files[k] for k in snapshots])
        wrong = [f for f, name in full.items() if lengths.get(name) != slow * size]
    if wrong:
        raise ValueError(f"{len(wrong)} files are missing or don't have {slow * size} bytes: {sorted(wrong)[:3]}")
    sent = None
    if mounted:
        planes = _read_mounted(spark, {int(k): files[k] for k in snapshots}, slow * size)
    elif whole:
        by_name = defaultdict(list)
        for k in snapshots:
            by_name[full[files[k]]].append(int(k))
        sent = spark.sparkContext.broadcast(dict(by_name))  # the names, which the caller holds
        planes = found.filter(F.col("length") == slow * size).select("path", F.col("content").alias("raw"))
    else:
        # No data source reads records of a fixed length; their numbers follow the order of the files and of their splits.
        sent = spark.sparkContext.broadcast([int(k) for k in snapshots])
        planes = spark.createDataFrame(spark.sparkContext.binaryRecords(",".join(files[k] for k in snapshots), size).zipWithIndex(), "raw binary, i long")
    sign = lambda k, n: np.where(k <= n // 2, k, k - n)
    names = [f"v{k}" for k in range(components)] if space == "real" else [f"{q}{k}" for k in range(components) for q in ("re", "im")]
    keys = POINT if space == "real" else MODE

    def unpack(units: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        a = np.frombuffer(b"".join(raw for _, _, raw in units), kind).reshape(-1, middle, fast, width)
        many = [len(raw) // size for _, _, raw in units]
        p = np.concatenate([np.arange(at, at + n) for (_, at, _), n in zip(units, many)])
        mid = np.arange(middle)
        if space != "real":
            p, mid = sign(p, grid.ny), sign(mid, grid.nz)
        columns = [
            np.repeat(np.repeat(np.array([k for k, _, _ in units], np.int64), many), middle * fast),
            np.repeat(p, middle * fast).astype(np.int32), np.tile(np.repeat(mid, fast), len(a)).astype(np.int32), np.tile(np.arange(fast), middle * len(a)).astype(np.int32),
            *(a[..., k].ravel().astype(float) for k in range(width)),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*keys, *names])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, waiting = [], 0
        for batch in batches:
            for which, raw in zip(batch.column("snapshot" if mounted else "path" if whole else "i").to_pylist(), batch.column("raw")):
                for k, p in [(which, 0)] if mounted else [(k, 0) for k in sent.value.get(which, ())] if whole else [(sent.value[which // slow], which % slow)]:
                    units.append((k, p, raw.as_buffer()))
                    waiting += len(units[-1][2])
                    if waiting >= BATCH_BYTES:
                        yield unpack(units)
                        units, waiting = [], 0
        if units:
            yield unpack(units)

    schema = f"snapshot long, {', '.join(f'{k} int' for k in keys[1:])}, {', '.join(f'{n} double' for n in names)}"
    kind_of = RealField if space == "real" else SpectralField
    return kind_of(planes.mapInArrow(parse, schema), grid, components)


def binary_planes(field: RealField | SpectralField, precision: str = "double") -> DataFrame:
    """snapshot, p (the slowest axis) and the plane's bytes in native order; the planes one after another are the file."""
    kind = {"double": "f8", "single": "f4"}[precision]
    g, names = field.grid, field.values
    if isinstance(field, RealField):
        keys, shape = ("iz", "iy", "ix"), (g.ny, g.nx, len(names))
    else:
        keys, shape = ("ky", "kz", "kx"), (g.nz, g.nx // 2 + 1, len(names))
    wrap = lambda name, n: F.pmod(F.col(name), F.lit(n)).cast("int")
    rows = field.df.select(F.col("snapshot").cast("long").alias("snapshot"), (wrap(keys[0], g.ny) if keys[0] == "ky" else F.col(keys[0]).cast("int")).alias("p"), (wrap(keys[1], g.nz) if keys[0] == "ky" else F.col(keys[1])).alias("q"), F.col(keys[2]).alias("r"), *names)
    most = max(1, BATCH_BYTES // (int(np.prod(shape)) * np.dtype(kind).itemsize))

    def emit(planes: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in planes], pa.int64()), pa.array([p for _, p, _ in planes], pa.int32()), pa.array([a.tobytes() for *_, a in planes], pa.binary())], names=["snapshot", "p", "raw"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last plane, which may go on in the next batch
        for batch in batches:
            k, p, q, r, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(k):
                continue
            heads = np.nonzero(np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])])[0]
            ends = np.r_[heads[1:], len(k)]
            for lo in range(0, len(heads), most):
                own = slice(lo, lo + most)
                rows = slice(heads[own][0], ends[own][-1])
                keys = list(zip(k[heads[own]].tolist(), p[heads[own]].tolist()))
                a = np.zeros((len(keys), *shape), kind)
                if held is not None and held[:2] == keys[0]:
                    a[0] = held[2]
                elif held is not None:
                    yield emit([held])
                a[np.repeat(np.arange(len(keys)), ends[own] - heads[own]), q[rows], r[rows]] = np.stack([v[rows] for v in values], 1)
                if len(keys) > 1:
                    yield emit([(*key, plane) for key, plane in zip(keys[:-1], a)])
                held = (*keys[-1], a[-1].copy())
        if held is not None:
            yield emit([held])

    return rows.repartition("snapshot", "p").sortWithinPartitions("snapshot", "p").mapInArrow(pack, "snapshot long, p int, raw binary")


def write_binary(field: RealField | SpectralField, path: str | Callable[[int], str], precision: str = "double") -> list[int]:
    """Native files, one for each snapshot where ``path`` gives names by snapshot; the snapshots.

    A file has one writer.  In a mounted folder, which driver and executors must share, that is a
    task for each file; in any other file system planes stream through the driver.
    """
    spark = field.df.sparkSession
    planes = written(binary_planes(field, precision), "planes")
    try:
        if (first := planes.select("snapshot").first()) is None:
            return []
        if not callable(path) and planes.select("snapshot").distinct().limit(2).count() > 1:
            raise ValueError("one file holds one snapshot")
        name = path if callable(path) else lambda k: path
        at = spark._jvm.org.apache.hadoop.fs.Path(name(first[0]))
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
            return _write_mounted(planes, name)
        return _write_streamed(planes, name)
    finally:
        drop_written(planes)


def _write_mounted(planes: DataFrame, name: Callable[[int], str]) -> list[int]:
    """Every file by the task that has its planes; a file takes its name once it is whole."""
    base = os.getcwd()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, at = [], None, ""

        def end() -> None:
            folder, file = os.path.split(at)
            out.close()
            os.replace(out.name, at)
            with contextlib.suppress(FileNotFoundError):
                os.remove(f"{folder}/.{file}.crc")  # Hadoop's sum of a file that stood here

        try:
            for batch in batches:
                for k, raw in zip(batch.column("snapshot").to_pylist(), batch.column("raw")):
                    if not done or done[-1] != k:
                        if out is not None:
                            end()
                        at = _local(name(k), base)
                        os.makedirs(os.path.dirname(at), exist_ok=True)
                        out = open(f"{os.path.dirname(at)}/.{os.path.basename(at)}-{uuid.uuid4().hex}", "wb")
                        done.append(k)
                    out.write(raw.as_buffer())
            if out is not None:
                end()
        finally:
            if out is not None and not out.closed:
                out.close()
                os.remove(out.name)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["snapshot"])

    return sorted(r[0] for r in planes.repartition("snapshot").sortWithinPartitions("snapshot", "p").mapInArrow(put, "snapshot long").collect())  # one number for each file


def _write_streamed(planes: DataFrame, name: Callable[[int], str]) -> list[int]:
    """Every file by the driver, one partition's planes at a time."""
    spark, out, done = planes.sparkSession, None, []
    try:
        for row in planes.orderBy("snapshot", "p").toLocalIterator():
            if not done or done[-1] != row["snapshot"]:
                if out is not None:
                    out.close()
                done.append(row["snapshot"])
                at = spark._jvm.org.apache.hadoop.fs.Path(name(row["snapshot"]))
                out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
            out.write(bytearray(row["raw"]))
    finally:
        if out is not None:
            out.close()
    return done


def binary_to_table(spark: SparkSession, files: dict[int, str], path: str, name: str, grid: Grid, components: int, precision: str = "double", space: str = "real") -> None:
    """Native files by iteration, converted into a table of snapshots."""
    write_field(read_binaries(spark, files, grid, components, precision, space), path, name)


def dense(field: RealField) -> np.ndarray:
    """A snapshot as a (z, y, x[, component]) array, for small grids."""
    g = field.grid
    pdf = field.df.toPandas()
    a = np.zeros((g.nz, g.ny, g.nx, field.components))
    a[pdf["iz"], pdf["iy"], pdf["ix"]] = pdf[field.values].to_numpy()
    return a[..., 0] if field.components == 1 else a
