"""Rows numbered in an order over the whole table, without one task that holds them all."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder, which survives lost executors; on a single machine where none is set,
    to one of our own."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {context.master} share")
            folder = tempfile.mkdtemp(prefix="atomspan_")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def running_total(df: DataFrame, value: Column, name: str, *order: Column | str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows before, in an order. Rows are dealt into ranges of that order, as
    many as shuffle partitions; sums of ranges, a row each, are added up, and each range is summed on its own."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = checkpointed(df.withColumn("__v", value).repartitionByRange(*cols).withColumn("__part", F.spark_partition_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__part").agg(F.sum("__v").alias("__s"))
    starts = parts.select("__part", F.coalesce(F.sum("__s").over(before.orderBy("__part")), F.lit(0)).alias("__b"))
    inside = F.coalesce(F.sum("__v").over(before.partitionBy("__part").orderBy(*cols)), F.lit(0))
    return rows.withColumn("__i", inside).join(F.broadcast(starts), "__part").withColumn(name, F.col("__i") + F.col("__b")).drop("__v", "__part", "__i", "__b")
