"""Streams: running feature statistics, and frames in windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def feature_statistics(stream: DataFrame, vector: str = "fingerprint") -> DataFrame:
    """(dim, n, mean, std) over all vectors so far; write it in complete mode."""
    v = stream.select(F.posexplode(vector).alias("dim", "v"))
    return v.groupBy("dim").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.sqrt(F.var_pop("v") + 1e-12).alias("std"))


def windowed_energies(stream: DataFrame, time: str, value: str, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """(start, n, mean, low) by windows of time; rows later than ``late`` are left out."""
    t = stream.withWatermark(time, late)
    out = t.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"))
    return out.select(F.col("w.start").alias("start"), "n", "mean", "low")
