"""Vector sets: moments, fingerprints, scaling, pairwise metrics, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


#: Vectors whose pairs are listed, at most.
PAIR_ROWS = 10_000
#: Vectors in a block of those whose pairs are summed.
PAIR_BLOCK = 2_000


def long_form(vectors: DataFrame, keys: tuple[str, ...], vector: str) -> DataFrame:
    """(keys, dim, v): a row for each component."""
    return vectors.select(*keys, F.posexplode(vector).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))


def moments(rows: DataFrame, keys: tuple[str, ...], order: int, value: str = "v") -> DataFrame:
    """(keys, m1..): mean, then central population moments, from sums of powers in one pass over shifted values."""
    if order < 1:
        raise ValueError("moments begin at 1")
    mean = rows.groupBy(*keys).agg(F.avg(value).alias("m1"))
    if order == 1:
        return mean
    dev = F.col(value) - F.col("m1")
    more = rows.join(mean, list(keys)).groupBy(*keys, "m1").agg(*[F.avg(F.pow(dev, k)).alias(f"m{k}") for k in range(2, order + 1)])
    return more.select(*keys, *[f"m{k}" for k in range(1, order + 1)])


def global_fingerprint(rows: DataFrame, inner: int, outer: int, sid: str = "sid", species: str = "species", vector: str = "fingerprint") -> DataFrame:
    """(sid, dim, inner, m1..): outer moments, over species, of the inner moments of each species' components."""
    own = moments(long_form(rows, (sid, species), vector), (sid, species, "dim"), inner)
    each = own.select(sid, species, "dim", F.posexplode(F.array(*[f"m{k}" for k in range(1, inner + 1)])).alias("inner", "v"))
    return moments(each.withColumn("inner", F.col("inner") + 1), (sid, "dim", "inner"), outer)


def moment_fingerprint(rows: DataFrame, species: list[str], inner: int, outer: int = 0, weights: dict[str, float] | None = None, append: bool = True, sid: str = "sid", vector: str = "fingerprint") -> DataFrame:
    """(sid, fingerprint): a structure's inner moments of each declared species' components, in the order of species, moment
    and component; with ``outer``, moments over species of these in place of them.

    A species that a structure lacks counts as zeros, or is left out where a structure has none of its atoms only if the
    species isn't declared. Weights of species: their products with the moments follow the moments, or with ``append`` False
    take their place. A moment of 0 is no moment: orders begin at 1.
    """
    if inner < 1 or outer < 0:
        raise ValueError("moments begin at 1")
    own = moments(long_form(rows.where(F.col("species").isin(species)), (sid, "species"), vector), (sid, "species", "dim"), inner)
    size = rows.agg(F.max(F.size(vector))).scalar()
    every = rows.select(sid).distinct().select(sid, F.explode(F.array(*map(F.lit, species))).alias("species")).select(sid, "species", F.explode(F.sequence(F.lit(0), size - 1)).alias("dim"))
    full = every.join(own, [sid, "species", "dim"], "left")
    w = F.coalesce(*[F.when(F.col("species") == s, F.lit(float((weights or {}).get(s, 1.0)))) for s in species])
    plain = [F.coalesce(F.col(f"m{k}"), F.lit(0.0)) for k in range(1, inner + 1)]
    values = plain if weights is None else ([*plain, *[v * w for v in plain]] if append else [v * w for v in plain])
    place = F.array_position(F.array(*map(F.lit, species)), F.col("species"))
    long = full.select(sid, place.alias("s"), "dim", F.posexplode(F.array(*values)).alias("m", "v"))
    if outer:
        o = moments(long, (sid, "m", "dim"), outer)
        long = o.select(sid, F.posexplode(F.array(*[f"m{k}" for k in range(1, outer + 1)])).alias("s", "v"), "m", "dim")
    return long.groupBy(sid).agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "m", "dim", "v"))), lambda x: x["v"]).alias("fingerprint"))


def feature_stats(rows: DataFrame) -> DataFrame:
    """(dim, mean, std, low, high) with std = sqrt(variance + 1e-12), of the long form."""
    return rows.groupBy("dim").agg(F.avg("v").alias("mean"), F.sqrt(F.var_pop("v") + 1e-12).alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))


def standardize(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, dim, v): less the mean, over the sample deviation; a deviation below 1e-10 counts as 1."""
    s = rows.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    scale = F.when(F.col("s").isNull() | (F.col("s") < 1e-10), 1.0).otherwise(F.col("s"))
    return rows.join(F.broadcast(s), "dim").select(*keys, "dim", ((F.col("v") - F.col("m")) / scale).alias("v"))


def pair_metrics(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(a, b, euclid, cosine, pearson) of all pairs of a small set, such as a structure's or a selection's vectors.

    The output has a row for each pair, so more than PAIR_ROWS vectors are an error; sets that are large are summarised by
    :func:`pair_means`.
    """
    if vectors.limit(PAIR_ROWS + 1).count() > PAIR_ROWS:
        raise ValueError(f"all pairs of more than {PAIR_ROWS} vectors; pair_means gives their means")
    v = vectors.select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    a, b = v.toDF("a", "va"), v.toDF("b", "vb")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, t: s + t) / F.size(x)
    pairs = a.join(b, F.col("a") < F.col("b")).withColumns({"ab": dot("va", "vb"), "aa": dot("va", "va"), "bb": dot("vb", "vb"), "ma": mean("va"), "mb": mean("vb"), "n": F.size("va")})
    norm = F.sqrt("aa") * F.sqrt("bb")
    spread = F.sqrt(F.greatest(F.col("aa") - F.col("n") * F.col("ma") * F.col("ma"), F.lit(0.0))) * F.sqrt(F.greatest(F.col("bb") - F.col("n") * F.col("mb") * F.col("mb"), F.lit(0.0)))
    return pairs.select("a", "b", F.sqrt(F.greatest(F.col("aa") + F.col("bb") - 2 * F.col("ab"), F.lit(0.0))).alias("euclid"), F.when(norm <= 1e-10, 0.0).otherwise(F.try_divide("ab", norm)).alias("cosine"), F.when(spread <= 1e-10, 0.0).otherwise(F.try_divide(F.col("ab") - F.col("n") * F.col("ma") * F.col("mb"), spread)).alias("pearson"))


def mean_cosine(vectors: DataFrame, vector: str) -> DataFrame:
    """(n, mean_cosine) over all pairs without forming them: |sum of unit vectors|^2 = n + 2 * sum over pairs."""
    v = vectors.select(F.transform(vector, lambda x: x.cast("double")).alias("v")).withColumn("r", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, t: s + t * t)))
    unit = v.withColumn("u", F.transform("v", lambda x: F.when(F.col("r") <= 1e-10, 0.0).otherwise(F.try_divide(x, F.col("r")))))
    sums = unit.select(F.posexplode("u").alias("dim", "u")).groupBy("dim").agg(F.sum("u").alias("u"))
    n = unit.agg(F.count("*").alias("n"), F.sum((F.col("r") > 1e-10).cast("long")).alias("full"))
    total = sums.agg(F.sum(F.col("u") * F.col("u")).alias("q"))
    return n.join(F.broadcast(total)).select("n", F.try_divide(F.col("q") - F.col("full"), F.col("n") * (F.col("n") - 1)).alias("mean_cosine"))


def _distance_sum(v: DataFrame, n: int) -> float:
    """The sum of the distances of all pairs of (k, v): vectors fall into blocks of about PAIR_BLOCK by a hash, and each pair of blocks
    is one group, which gives one number."""
    blocks = max(1, -(-n // PAIR_BLOCK))
    rows = v.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    units = rows.select(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "v")

    def run(pdf):
        import pandas as pd

        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        x = np.array(pdf["v"].tolist(), float)
        own = pdf["b"].to_numpy() == p
        one, two = (x, x) if p == q else (x[own], x[~own])
        total = sum(np.sqrt(((two[(i + 1 if p == q else 0) :] - r) ** 2).sum(1)).sum() for i, r in enumerate(one))
        return pd.DataFrame({"s": [float(total)]})

    return units.groupBy("p", "q").applyInPandas(run, "s double").agg(F.sum("s")).first()[0] or 0.0


def pair_means(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(n, mean_euclid, mean_cosine, mean_pearson) over all pairs of vectors; fewer than two raise.

    Cosine and Pearson need no pairs; the mean distance has no such form, so blocks of vectors are compared in tasks, which
    give sums, at a cost of the square of the number of vectors. A constant vector has correlation 0.
    """
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    n = v.count()
    if n < 2:
        raise ValueError("a mean over pairs needs two vectors")
    euclid = _distance_sum(v, n) / (n * (n - 1) / 2)
    means = v.withColumn("m", F.aggregate("v", F.lit(0.0), lambda s, t: s + t) / F.size("v"))
    pearson = mean_cosine(means.select(F.transform("v", lambda x: x - F.col("m")).alias("v")), "v").select(F.col("mean_cosine").alias("mean_pearson"))
    return mean_cosine(v, "v").join(F.broadcast(pearson)).select("n", F.lit(float(euclid)).alias("mean_euclid"), "mean_cosine", "mean_pearson")


def log_det(vectors: DataFrame, vector: str, alpha: float = 1e-3) -> float:
    """log det of the covariance plus alpha times its mean variance; fewer than two vectors raise.

    Sums of products of components are made in the cluster; the driver gets one matrix of the vectors' length.
    """
    rows = vectors.select(F.transform(vector, lambda x: x.cast("double")).alias("v")).withColumn("id", F.monotonically_increasing_id())
    a = rows.select("id", F.posexplode("v").alias("i", "x"))
    n = rows.count()
    if n < 2:
        raise ValueError("a covariance needs two vectors")
    outer = rows.select(F.posexplode("v").alias("i", "x"), "v").select("i", "x", F.posexplode("v").alias("j", "y")).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("q")).collect()
    sums = {r["i"]: r["s"] for r in a.groupBy("i").agg(F.sum("x").alias("s")).collect()}
    d = len(sums)
    m = np.zeros((d, d))
    for r in outer:
        m[r["i"], r["j"]] = r["q"] - sums[r["i"]] * sums[r["j"]] / n
    cov = m / (n - 1)
    return float(np.linalg.slogdet(cov + alpha * np.trace(cov) / d * np.eye(d))[1])


def cluster(vectors: DataFrame, k: int, components: int, seed: int = 0, key: str = "sid", vector: str = "fingerprint", energy: str = "energy") -> tuple[DataFrame, DataFrame]:
    """Vectors scaled, projected and clustered by k-means: (rows with ``cluster``), (cluster, n, mean, std) by mean energy."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    steps = [StandardScaler(inputCol="__v", outputCol="__s", withMean=True), PCA(k=components, inputCol="__s", outputCol="__p"), KMeans(k=k, seed=seed, featuresCol="__p", predictionCol="cluster")]
    out = Pipeline(stages=steps).fit(rows).transform(rows).drop("__v", "__s", "__p")
    return out, out.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(energy).alias("mean"), F.stddev_pop(energy).alias("std")).orderBy("mean")
