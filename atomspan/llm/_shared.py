"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Bytes of an Arrow batch, about; one row may be more.
BATCH_BYTES = 4 << 20
#: Rows of a key that don't make it hot.
HOT_ROWS = 200


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a new one of our own on a single machine, as in tests; on a
    cluster, whose machines don't share such a folder, an error."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        folder = tempfile.mkdtemp(prefix="atomspan_")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, with batches of about BATCH_BYTES: rows hold whole texts, so a number of rows bounds no memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if (given := conf.get(name).rstrip("b")) and (not given.isdigit() or int(given) > BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut in its lineage that survives lost executors."""
    df.write.parquet(path := f"{shared_folder(df.sparkSession)}/{name}_{uuid.uuid4().hex}")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what :func:`stored` wrote for ``df``, which nothing needs any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hot_join(rows: DataFrame, unique: DataFrame, key: str, size: str, total: int, how: str = "inner", largest: int | None = None) -> DataFrame:
    """``rows`` joined to ``unique``, which has a row for each key, by ``key``; ``size``: how many rows have that key.

    Keys that more than a quarter of a task's even share of ``total`` rows have would fill one task; they are broadcast, as
    there are at most four times as many as tasks; no key of up to HOT_ROWS rows is. The others are joined as usual.
    Null keys match nothing. ``largest``: the largest size, if it is known; where it says that no key is hot, the join is a
    plain one. ``size`` is left out. The broadcast table is one of hashes: Spark holds tables by a
    number in little memory, by anything else in pages of many megabytes each.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(total // (4 * parts), HOT_ROWS)
    values = [c for c in unique.columns if c not in (key, size)]
    if largest is not None and largest <= limit and how == "inner":
        return rows.join(unique.drop(size), key).select(*[F.col(f"`{c}`") for c in rows.columns], *values)
    named = lambda df, tag: df.select(F.col(key).alias(f"__{tag}"), F.struct(*values).alias(f"__{tag}v"))
    hot = named(unique.where(F.col(size) > limit), "hot").withColumn("__hash", F.xxhash64("__hot"))
    cold = named(unique.where(F.col(size) <= limit), "cold")
    # Rows with a hot key or none go anywhere; their other join key is a number of their own that no key equals.
    met = rows.join(F.broadcast(hot), (F.xxhash64(key) == F.col("__hash")) & (F.col(key) == F.col("__hot")), "left")
    free = F.col("__hot").isNotNull() | F.col(key).isNull()
    met = met.withColumn("__spread", F.when(free, F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long"))).withColumn("__own", F.when(~free, F.col(key)))
    met = met.join(cold.withColumn("__none", F.lit(-1).cast("long")), (F.col("__own").eqNullSafe(F.col("__cold"))) & (F.col("__spread") == F.col("__none")), "left")
    found = F.coalesce("__hotv", "__coldv")
    if how == "inner":
        met = met.where(found.isNotNull())
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *[found[c].alias(c) for c in values])
