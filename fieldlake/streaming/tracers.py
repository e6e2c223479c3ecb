"""Statistics and trajectories over a stream of steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldlake.functions.kernels import adams_bashforth
from fieldlake.operators.stats import moment_aggregates


def windowed_moments(stream: DataFrame, time: str, keys: list[str], value: str, width: str, lateness: str) -> DataFrame:
    """Moments by tumbling window; rows later than ``lateness`` don't count."""
    w = F.window(time, width)
    out = stream.withWatermark(time, lateness).groupBy(w, *keys).agg(*moment_aggregates(F.col(value).cast("double")), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "min", *[f"m{k}" for k in range(1, 9)], "max", "n")


def integrate(stream: DataFrame, key: str, step: str, rhs: str, dt: float, steps: int) -> DataFrame:
    """Position of every particle after every step (key, step, x), from its right-hand sides as they come.

    The state of a particle is its last step, its position and its newest ``steps`` sides.  Rows
    of a batch are taken in order of their steps; steps that were seen already are left out.
    """
    weights = {s: [float(c) for c in adams_bashforth(s)] for s in range(1, steps + 1)}
    key_type = stream.schema[key].dataType.simpleString()

    def move(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, x, sides = state.get if state.exists else (-1, 0.0, [])
        sides = list(sides)
        rows = pd.concat(list(batches)).sort_values(step)
        out = []
        for k, r in zip(rows[step], rows[rhs]):
            if k <= last:
                continue
            sides = [float(r), *sides][:steps]
            x += dt * sum(c * s for c, s in zip(weights[len(sides)], sides))
            last = int(k)
            out.append((group[0], last, x))
        state.update((last, x, sides))
        yield pd.DataFrame(out, columns=[key, step, "x"])

    return stream.groupBy(key).applyInPandasWithState(move, f"{key} {key_type}, {step} long, x double", "last long, x double, sides array<double>", "append", GroupStateTimeout.NoTimeout)
