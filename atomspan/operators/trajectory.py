"""Operators over frames: displacements, unwrapping, epochs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def lag_pairs(points: DataFrame, lags: int, coords: tuple[str, ...] = ("x",), particle: str = "pid", frame: str = "frame") -> DataFrame:
    """(particle, frame, lag, d_<coord>) for lags 1..lags: an equi-join on particle and frame + lag."""
    later = points.select(particle, F.col(frame).alias("__f"), *[F.col(c).alias(f"__{c}") for c in coords])
    now = points.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("__f", F.col(frame) + F.col("lag"))
    return now.join(later, [particle, "__f"]).select(particle, frame, "lag", *[(F.col(f"__{c}") - F.col(c)).alias(f"d_{c}") for c in coords])


def msd(points: DataFrame, lags: int, coords: tuple[str, ...] = ("x",), particle: str = "pid", frame: str = "frame") -> DataFrame:
    """(lag, msd): mean over origins and particles of the squared displacement; lag 0 is 0."""
    pairs = lag_pairs(points, lags, coords, particle, frame)
    square = reduce(lambda a, b: a + b, [F.col(f"d_{c}") * F.col(f"d_{c}") for c in coords])
    zero = points.limit(1).select(F.lit(0).alias("lag"), F.lit(0.0).alias("msd"))
    return pairs.groupBy("lag").agg(F.avg(square).alias("msd")).unionByName(zero)


def total_squared_displacement(points: DataFrame, lags: int, coords: tuple[str, ...] = ("x",), particle: str = "pid", frame: str = "frame") -> DataFrame:
    """(lag, tsd): mean over origins of the square of all particles' summed displacement."""
    pairs = lag_pairs(points, lags, coords, particle, frame)
    each = pairs.groupBy("lag", frame).agg(*[F.sum(f"d_{c}").alias(c) for c in coords])
    square = reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in coords])
    return each.groupBy("lag").agg(F.avg(square).alias("tsd"))


def diffusivity(curve: DataFrame, dt: float, dimensions: int = 3, value: str = "msd") -> DataFrame:
    """(d): slope of the curve over time by least squares, over 2 * dimensions, in cm2/s for square angstrom and ps."""
    return curve.agg((F.regr_slope(F.col(value), F.col("lag") * dt) * 1e-4 / (2 * dimensions)).alias("d"))


def unwrap(points: DataFrame, period: float, coord: str = "x", particle: str = "pid", frame: str = "frame") -> DataFrame:
    """``coord`` shifted by whole periods so that no step is longer than half of one: a running sum of wraps."""
    w = Window.partitionBy(particle).orderBy(frame)
    step = F.rint((F.col(coord) - F.lag(coord).over(w)) / period)
    return points.withColumn("__n", F.coalesce(step, F.lit(0.0))).withColumn(coord, F.col(coord) - period * F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__n")


def epoch_summary(epochs: DataFrame, run: str = "run", epoch: str = "epoch", value: str = "rmse") -> DataFrame:
    """(run, n, final, best, best_epoch): last value, smallest value, and the first epoch that has it; finite values only."""
    ok = epochs.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return ok.groupBy(run).agg(F.count("*").alias("n"), F.max_by(value, epoch).alias("final"), F.min(value).alias("best"), F.min_by(epoch, F.struct(value, epoch)).alias("best_epoch"))


def best_so_far(epochs: DataFrame, run: str = "run", epoch: str = "epoch", value: str = "rmse") -> DataFrame:
    """With ``is_best``: strictly below every value before."""
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    before = F.min(value).over(w)
    return epochs.withColumn("is_best", before.isNull() | (F.col(value) < before))
