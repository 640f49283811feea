"""Queries of the mixed models: what a term adds, and whether an effect bends. Numpy states their results in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import curves, measures, mixed
from marlstone.plans.queries import query, table

#: Replicas of the registered queries; the operators' own number is 1000.
REPLICAS = 50


def priced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's nation, balance and segment, and the logarithm of their price."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 0").select("o_custkey", F.log("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", (F.col("c_acctbal") / 1000).alias("balance"), "c_mktsegment")
    return orders.join(customers, "o_custkey")


def _base() -> dict[str, F.Column]:
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return dict(zip(levels[1:], measures.one_hot(F.col("priority"), levels), strict=True))


@query()
def mixed_model_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a customer's balance and its square add to a model of order prices with nations and customers as random intercepts."""
    balance = F.col("balance") - 5
    found = mixed.added_fit(priced_orders(spark, sf_dir), _base(), {"balance": balance, "balance squared": balance * balance}, "price", "c_nationkey", "o_custkey", replicas=REPLICAS)
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "figure string, value double").withColumn("value", F.round("value", 6))


@query()
def bent_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect of a customer's balance on order prices as a spline, with its band and the P of its bend on every row."""
    curve = curves.bent_effect(priced_orders(spark, sf_dir), "balance", _base(), "price", "c_nationkey", "o_custkey", grid=21, replicas=REPLICAS)
    rows = [(*map(float, r), float(curve.tests["p"])) for r in zip(curve.x, curve.effect, curve.low, curve.high, strict=True)]
    return spark.createDataFrame(rows, "balance double, effect double, low double, high double, p double")
