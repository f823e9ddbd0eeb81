"""Committees of predictors: (structure, member, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ensemble_stats(rows: DataFrame, sid: str = "sid", value: str = "energy") -> DataFrame:
    """(sid, n, e_min, e_max, e_mean, e_std): over members; the standard deviation is the population's."""
    return rows.groupBy(sid).agg(F.count(value).alias("n"), F.min(value).alias("e_min"), F.max(value).alias("e_max"), F.avg(value).alias("e_mean"), F.stddev_pop(value).alias("e_std"))


def ensemble_reference(rows: DataFrame, reference: int, sid: str = "sid", member: str = "member", value: str = "energy") -> DataFrame:
    """(sid, energy, e_std): a member's own value with the committee's deviation."""
    return rows.groupBy(sid).agg(F.max(F.when(F.col(member) == reference, F.col(value))).alias("energy"), F.stddev_pop(value).alias("e_std"))


def force_uncertainty(rows: DataFrame, keys: tuple[str, ...] = ("sid", "aid"), components: tuple[str, ...] = ("fx", "fy", "fz")) -> DataFrame:
    """(keys, u): mean of the components' deviations over members."""
    dev = [F.stddev_pop(c) for c in components]
    total: Column = dev[0]
    for d in dev[1:]:
        total = total + d
    return rows.groupBy(*keys).agg((total / len(components)).alias("u"))


def force_std(rows: DataFrame, keys: tuple[str, ...] = ("sid", "aid"), components: tuple[str, ...] = ("fx", "fy", "fz")) -> DataFrame:
    """(keys, fx, fy, fz, fx_std, fy_std, fz_std): mean and deviation of each component over members."""
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in components], *[F.stddev_pop(c).alias(f"{c}_std") for c in components])


def structure_uncertainty(atoms: DataFrame, sid: str = "sid", u: str = "u") -> DataFrame:
    return atoms.groupBy(sid).agg(F.max(u).alias("u_max"), F.avg(u).alias("u_mean"))


def top_uncertain(stats: DataFrame, n: int, by: str = "e_std", sid: str = "sid") -> DataFrame:
    """The n rows of largest uncertainty; nulls last, ties by structure."""
    return stats.orderBy(F.desc_nulls_last(by), sid).limit(n)


def member_stats(runs: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(metric, n, mean, std, low, high) over members, non-finite values left out."""
    from ..functions.scalars import finite

    long = runs.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("e")).select("e.*").where(finite(F.col("v")))
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))
