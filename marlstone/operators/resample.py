"""Cluster bootstrap of grouped statistics: replicas are rows, so they run as tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def poisson_weight(cluster: Column, replica: Column, seed: int) -> Column:
    """How often a cluster is drawn in a replica: a Poisson(1) number from a hash of both, the same on every run."""
    u = F.pmod(F.xxhash64(cluster.cast("string"), replica, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    # cumulated Poisson(1) probabilities up to six draws
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    out = F.lit(0)
    for p in steps:
        out = out + (u >= p).cast("int")
    return out


def cluster_bootstrap(df: DataFrame, cluster: str, keys: Sequence[str], value: str, replicas: int = 1000, seed: int = 1009, points: Sequence[float] = (0.025, 0.975), least: float = 0.7) -> DataFrame:
    """Mean of ``value`` by key with a percentile interval over cluster resamples.

    Clusters are summed first, so a replica costs a row for each cluster and key and not for each row of data. A key
    whose statistic exists in fewer than ``least`` of the replicas (ten at least) has no interval.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    drawn = sums.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))).withColumn("_w", poisson_weight(F.col(cluster), F.col("_r"), seed))
    means = drawn.groupBy(*keys, "_r").agg(F.sum(F.col("_w") * F.col("_s")).alias("_s"), F.sum(F.col("_w") * F.col("_n")).alias("_n"))
    means = means.withColumn("_m", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")))
    spread = means.groupBy(*keys).agg(F.count("_m").alias("replicas"), F.percentile("_m", list(points)).alias("_q"))
    whole = sums.groupBy(*keys).agg((F.sum("_s") / F.sum("_n")).alias("mean"), F.sum("_n").alias("n"), F.count("*").alias("clusters"))
    enough = F.col("replicas") >= max(10, int(least * replicas))
    return whole.join(spread, list(keys)).select(*keys, "mean", "n", "clusters", "replicas", F.when(enough, F.col("_q")[0]).alias("low"), F.when(enough, F.col("_q")[1]).alias("high"))


def refit_bootstrap(df: DataFrame, cluster: str, terms: dict[str, Column], y: str, replicas: int = 1000, seed: int = 1009, points: Sequence[float] = (0.025, 0.975), least: float = 0.7) -> DataFrame:
    """Least squares refitted to cluster resamples: ``term, estimate, low, high, replicas``.

    A cluster is its sums of products, so a replica costs a row for each cluster; the replicas are solved where they lie.
    A resample with a singular design fails; with fewer than ``least`` of the replicas (ten at least) there is no interval.
    """
    names = ["intercept", *terms]
    p = len(names)
    data = df.select(F.col(cluster).alias("_c"), F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_x0"), *[c.cast("double").alias(f"_x{i + 1}") for i, c in enumerate(terms.values())]).na.drop()
    x = [F.col(f"_x{i}") for i in range(p)]
    cells = [x[i] * x[j] for i in range(p) for j in range(i, p)] + [v * F.col("_y") for v in x]
    sums = data.groupBy("_c").agg(*[F.sum(c).alias(f"s{k}") for k, c in enumerate(cells)])
    drawn = sums.withColumn("_r", F.explode(F.sequence(F.lit(-1), F.lit(replicas - 1))))
    # replica -1 is the whole, every cluster once
    drawn = drawn.withColumn("_w", F.when(F.col("_r") < 0, 1).otherwise(poisson_weight(F.col("_c"), F.col("_r"), seed))).where("_w > 0")
    moments = drawn.groupBy("_r").agg(F.array(*[F.sum(F.col("_w") * F.col(f"s{k}")) for k in range(len(cells))]).alias("m"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r, m in zip(frame["_r"], frame["m"], strict=True):
                xx = np.zeros((p, p))
                xx[np.triu_indices(p)] = m[: p * (p + 1) // 2]
                xx = xx + xx.T - np.diag(np.diag(xx))
                if np.linalg.matrix_rank(xx) == p:
                    rows += [(r, k, float(b)) for k, b in enumerate(np.linalg.solve(xx, np.asarray(m[p * (p + 1) // 2 :], float)))]
            yield pd.DataFrame(rows, columns=["_r", "_k", "_b"]).astype({"_r": "int32", "_k": "int32", "_b": "float64"})

    betas = moments.mapInPandas(solve, "_r int, _k int, _b double")
    out = betas.groupBy("_k").agg(F.max(F.when(F.col("_r") < 0, F.col("_b"))).alias("estimate"), F.percentile(F.when(F.col("_r") >= 0, F.col("_b")), list(points)).alias("_q"), F.count_if(F.col("_r") >= 0).alias("replicas"))
    enough = F.col("replicas") >= max(10, int(least * replicas))
    name = F.get(F.array(*map(F.lit, names)), F.col("_k"))
    return out.select(name.alias("term"), "estimate", F.when(enough, F.col("_q")[0]).alias("low"), F.when(enough, F.col("_q")[1]).alias("high"), "replicas")
