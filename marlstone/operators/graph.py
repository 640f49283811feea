"""Connected components by alternating large stars and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.staging import mark as used
from marlstone.staging import remove, stage_table, staged_since


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Component of every node that has an edge: columns ``node`` and ``root`` (its component's least node).

    Each round links every node's larger neighbours, then its smaller ones, to the
    least node seen; rounds grow with the logarithm of the nodes, not with the
    longest chain. Minima are pre-aggregated, so a hub costs no task of its own;
    every round is written to the shared folder, so lineage stays short.
    Null ends and loops are left out; an empty input has an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    pairs = pairs.where("_a is not null and _b is not null and u <> v").select("u", "v").distinct()
    spark, begun = edges.sparkSession, used()
    now = stage_table(pairs, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.withColumnRenamed("m", "v")).distinct()
        now, before = stage_table(small, "edges"), mark
        remove(spark, staged_since(begun)[:-1])  # only the last round is read again
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
