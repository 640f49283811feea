"""The spline analysis against dense matrices and the band's coverage of a known curve."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import curves, measures
from tests.test_mixed import search


def data(seed, bend, clusters=6, per=2, rows=7):
    rng = np.random.default_rng(seed)
    n = clusters * per * rows
    outer, inner = np.repeat(np.arange(clusters), per * rows), np.repeat(np.arange(clusters * per), rows)
    x, z = rng.gamma(3.0, 2.0, size=n), rng.normal(size=n)
    y = 0.4 * x + bend * np.maximum(x - 6, 0) ** 1.5 + 0.5 * z + rng.normal(size=clusters)[outer] * 0.6 + rng.normal(size=clusters * per)[inner] * 0.4 + rng.normal(size=n)
    return outer, inner, x, z, y


def test_basis_of_numbers_and_of_columns(spark):
    xs, knots = np.linspace(-2, 3, 9), [-1.0, 0.2, 0.9, 2.0]
    df = spark.createDataFrame([(float(v),) for v in xs], "x double")
    got = np.array([list(r) for r in df.select(*[c.alias(f"b{k}") for k, c in enumerate(measures.spline_basis(F.col("x"), knots))]).collect()])
    assert np.allclose(got, curves.spline_values(xs, knots))


def test_tests_and_curve_against_dense_matrices(spark):
    outer, inner, x, z, y = data(4, -0.8)
    df = spark.createDataFrame([(int(o), int(i), *map(float, r)) for o, i, *r in zip(outer, inner, x, z, y, strict=True)] + [(1, 1, None, 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0)], "o int, i int, x double, z double, y double")
    curve = curves.bent_effect(df, "x", {"z": F.col("z")}, "y", "o", "i", grid=11, replicas=24)
    xs, ys = (x - x.mean()) / x.std(ddof=1), (y - y.mean()) / y.std(ddof=1)
    knots = np.quantile(xs, curves.KNOTS)
    straight = np.column_stack([np.ones(len(x)), z, xs])
    spline = np.column_stack([straight, curves.spline_values(xs, knots)])
    a, b = search(straight, ys, outer, inner), search(spline, ys, outer, inner)
    assert np.isclose(curve.tests["statistic"], 2 * (b[0] - a[0]), atol=5e-3) and curve.tests["rows"] == len(x)
    assert np.isclose(curve.tests["spline_aic"], 2 * 7 - 2 * b[0], atol=5e-3) and curve.tests["p"] < 0.01 and curve.tests["finer_statistic"] >= 0
    grid = np.linspace(*np.quantile(x, curves.SHOWN), 11)
    at = (grid - x.mean()) / x.std(ddof=1)
    middle = np.median(xs)
    want = np.column_stack([at - middle, curves.spline_values(at, knots) - curves.spline_values([middle], knots)]) @ b[1][2:]
    assert np.allclose(curve.x, grid) and np.allclose(curve.effect, want, atol=2e-3)
    assert curve.tests["success"] >= 17 and (curve.low <= curve.effect + 0.05).all() and (curve.high >= curve.effect - 0.05).all() and (curve.high - curve.low)[0] > 0.01


def test_a_straight_effect_is_not_bent_and_flat_columns_are_errors(spark):
    outer, inner, x, z, y = data(6, 0.0)
    df = spark.createDataFrame([(int(o), int(i), float(a), float(c)) for o, i, a, c in zip(outer, inner, x, y, strict=True)], "o int, i int, x double, y double")
    curve = curves.bent_effect(df, "x", {}, "y", "o", "i", grid=5, replicas=5)
    assert curve.tests["p"] > 0.01 and np.isnan(curve.low).all()
    with pytest.raises(ValueError):
        curves.bent_effect(df.withColumn("x", F.lit(1.0)), "x", {}, "y", "o", "i")
    with pytest.raises(ValueError):
        curves.bent_effect(df.withColumn("x", (F.col("i") % 2).cast("double")), "x", {}, "y", "o", "i")
