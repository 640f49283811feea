"""Quantiles by rank selection against numpy, with groups far larger than what is sorted together."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import measures

POINTS = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("shape", ["normal", "ties", "outlier", "geometric", "infinite"])
def test_large_and_small_groups(spark, monkeypatch, shape):
    monkeypatch.setattr(measures, "TOGETHER", 20)
    monkeypatch.setattr(measures, "INTERVALS", 16 if shape == "normal" else 256)
    rng = np.random.default_rng(7)
    values = {
        "normal": rng.normal(size=900), "ties": rng.integers(0, 4, size=900).astype(float), "outlier": np.append(rng.normal(size=899), 1e300),
        "geometric": 10.0 ** rng.integers(-250, 250, size=900), "infinite": np.append(rng.normal(size=897), [math.inf, -math.inf, 1.7e308]),
    }[shape]
    rows = [("large", float(v)) for v in values] + [("small", float(v)) for v in values[:7]] + [("one", 3.0), ("none", None), ("small", None), ("small", math.nan)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.quantiles for r in measures.quantiles(df, ["k"], "v", POINTS).collect()}
    assert got["none"] is None and got["one"] == [3.0] * 6 and set(got) == {"large", "small", "one", "none"}
    assert np.allclose(got["large"], np.quantile(values, POINTS), rtol=1e-9) or shape == "infinite"
    assert np.allclose(got["small"], np.quantile(values[:7], POINTS), rtol=1e-9)
    if shape == "infinite":
        assert got["large"][0] == -math.inf and got["large"][-1] == math.inf and np.isclose(got["large"][3], np.median(values))


def test_medians_of_several_columns_without_keys(spark, monkeypatch):
    monkeypatch.setattr(measures, "TOGETHER", 5)
    df = spark.range(101).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"), F.when(F.col("id") > 90, F.col("id") * 1.5).alias("b"))
    got = {(r.k, r.metric): (r.median, r.n) for r in measures.group_medians(df, ["k"], ["a", "b"]).collect()}
    assert got == {(0, "a"): (50.0, 51), (1, "a"): (50.0, 50), (0, "b"): (144.0, 5), (1, "b"): (142.5, 5)}
    assert [r.quantiles for r in measures.quantiles(df, [], "a", [0.5]).collect()] == [[50.0]]
