"""The driver's tables read as fields, trajectories and samples, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlake.functions.grid import Grid
from fieldlake.model import RealField, points

LINE = Grid(64)
CUBE = Grid(4, 4, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sig1d(spark, d) -> RealField:
    """Each embedding as a periodic signal of 64 points."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("snapshot"), F.posexplode("embedding").alias("ix", "v0"))
    return RealField(rows.select("snapshot", F.lit(0).alias("iz"), F.lit(0).alias("iy"), "ix", F.col("v0").cast("double").alias("v0")), LINE, 1)


def _cube(p):
    return [F.floor(p / 16).cast("int").alias("iz"), (F.floor(p / 4) % 4).cast("int").alias("iy"), (p % 4).cast("int").alias("ix")]


def scal3d(spark, d) -> RealField:
    """Each embedding as a scalar on 4 x 4 x 4 points."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("snapshot"), F.posexplode("embedding").alias("p", "v0"))
    return RealField(rows.select("snapshot", *_cube(F.col("p")), F.col("v0").cast("double").alias("v0")), CUBE, 1)


def vec3d(spark, d) -> RealField:
    """Three embeddings in a row as a vector field; incomplete triplets are left out.

    Whole embeddings are brought together, not their points (for the first line along x only the
    line's values of each); of several with one number each point has the largest value.
    """
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).cast("long").alias("snapshot"), (F.col("vec_id") % 3).alias("c"), "embedding")
    largest = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y))

    def together(values) -> DataFrame:
        own = [F.collect_list(F.when(F.col("c") == k, values)).alias(f"v{k}") for k in range(3)]
        found = e.groupBy("snapshot").agg(*own).filter("size(v0) > 0 and size(v1) > 0 and size(v2) > 0")
        one = [F.when(F.size(v) == 1, F.get(v, F.lit(0))).otherwise(F.aggregate(v, F.get(v, F.lit(0)), largest)).alias(v) for v in ("v0", "v1", "v2")]
        return found.select("snapshot", *one)

    whole, line = together(F.col("embedding")), together(F.slice("embedding", 1, CUBE.nx))
    return RealField(points(whole, ["snapshot"], ["v0", "v1", "v2"]).select("snapshot", *_cube(F.col("p")), "v0", "v1", "v2"), CUBE, 3, whole, line)


def traj(spark, d) -> DataFrame:
    """Events of a user in order, as a particle's steps."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("particle"), F.row_number().over(w).alias("step"), F.col("value").alias("x"))


def pts(spark, d) -> DataFrame:
    """Event values as positions on a line of length 2 pi."""
    return table(spark, d, "events").select(F.col("event_id").alias("particle"), (F.col("value") / 500 * 6.283185307179586).alias("x"))


def orders3(spark, d) -> DataFrame:
    """Orders as positions in the cube."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("particle"), (F.col("o_totalprice") % 7).alias("x"), (F.col("o_custkey") % 97 / 13.0).alias("y"), (F.col("o_orderkey") % 89 / 11.0 - 2.0).alias("z"))


SIG = "sig AS (SELECT vec_id AS snapshot, unnest(range(64)) AS ix, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
SPEC = f"""{SIG}, spec AS (
  SELECT snapshot, kx, sum(v * cos(2 * pi() * ((ix * kx) % 64) / 64)) / 64 AS re, -sum(v * sin(2 * pi() * ((ix * kx) % 64) / 64)) / 64 AS im,
         CASE WHEN kx = 0 THEN 1 ELSE 2 END AS nx
  FROM sig, (SELECT unnest(range(33)) AS kx) GROUP BY snapshot, kx)"""
_P = "(p // 16) AS iz, ((p // 4) % 4) AS iy, (p % 4) AS ix"
SCAL = f"sc AS (SELECT snapshot, {_P}, v FROM (SELECT vec_id AS snapshot, unnest(range(64)) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"
MODES = "modes AS (SELECT ky, kz, kx, kx * kx + ky * ky + kz * kz AS k2 FROM (SELECT unnest(range(-1, 3)) AS ky), (SELECT unnest(range(-1, 3)) AS kz), (SELECT unnest(range(0, 3)) AS kx))"
_PHASE = "2 * pi() * (((ix * kx + iy * ky + iz * kz) % 4 + 4) % 4) / 4"


def sums(source: str, names: list[str]) -> str:
    """Transforms of the source's columns over the cube's modes, normalised: <name>r and <name>i."""
    parts = ", ".join(f"sum({n} * cos({_PHASE})) / 64 AS {n}r, -sum({n} * sin({_PHASE})) / 64 AS {n}i" for n in names)
    return f"SELECT snapshot, ky, kz, kx, k2, {parts} FROM {source}, modes GROUP BY snapshot, ky, kz, kx, k2"


def back(source: str, pairs: dict[str, tuple[str, str]]) -> str:
    """Inverse transforms of (re, im) expressions of a half spectrum."""
    weight = "CASE WHEN kx = 0 OR kx = 2 THEN 1 ELSE 2 END"
    parts = ", ".join(f"sum(({weight}) * (({re}) * cos({_PHASE}) - ({im}) * sin({_PHASE}))) AS {n}" for n, (re, im) in pairs.items())
    return f"SELECT snapshot, iz, iy, ix, {parts} FROM {source}, points GROUP BY snapshot, iz, iy, ix"


POINTS = "points AS (SELECT iz, iy, ix FROM (SELECT unnest(range(4)) AS iz), (SELECT unnest(range(4)) AS iy), (SELECT unnest(range(4)) AS ix))"
VEC = f"""ve AS (SELECT vec_id // 3 AS snapshot, vec_id % 3 AS c, unnest(range(64)) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), vec AS (
  SELECT snapshot, {_P}, a, b, d FROM (SELECT snapshot, p, max(CASE WHEN c = 0 THEN v END) AS a, max(CASE WHEN c = 1 THEN v END) AS b, max(CASE WHEN c = 2 THEN v END) AS d FROM ve GROUP BY snapshot, p)
  WHERE a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL)"""
VSPEC = f"{VEC}, {MODES}, vs AS ({sums('vec', ['a', 'b', 'd'])})"
SSPEC = f"{SCAL}, {MODES}, ss AS ({sums('sc', ['v'])})"
TRAJ = "traj AS (SELECT user_id AS particle, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS x FROM events)"
PTS = "pts AS (SELECT event_id AS particle, value / 500 * 6.283185307179586 AS x FROM events)"
PTS3 = "pts3 AS (SELECT o_orderkey AS particle, o_totalprice % 7 AS x, o_custkey % 97 / 13.0 AS y, o_orderkey % 89 / 11.0 - 2.0 AS z FROM orders)"
