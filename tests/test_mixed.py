"""Mixed models against dense matrices, and their resamples against refits of resampled rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import mixed


def sample(seed, clusters=10, per=4, rows=6, outer_sd=0.8, inner_sd=0.4):
    rng = np.random.default_rng(seed)
    outer = np.repeat(np.arange(clusters), per * rows)
    inner = np.repeat(np.arange(clusters * per), rows)
    x, z = rng.normal(size=len(outer)), rng.normal(size=len(outer))
    y = 1 + 0.5 * x + rng.normal(size=clusters)[outer] * outer_sd + rng.normal(size=clusters * per)[inner] * inner_sd + rng.normal(size=len(outer)) * 0.6
    return outer, inner, x, z, y


def frame(spark, outer, inner, x, z, y):
    return spark.createDataFrame([(int(a), int(b), *map(float, r)) for a, b, *r in zip(outer, inner, x, z, y, strict=True)], "o int, i int, x double, z double, y double").repartition(3)


def dense(d, y, outer, inner, a, b):
    """Profile log-likelihood, coefficients and residual variance by the whole covariance matrix."""
    n = len(y)
    v = np.eye(n) + a * (outer[:, None] == outer) + b * (inner[:, None] == inner)
    w = np.linalg.inv(v)
    beta = np.linalg.solve(d.T @ w @ d, d.T @ w @ y)
    e = y - d @ beta
    s = e @ w @ e / n
    return -0.5 * (n * np.log(2 * np.pi * s) + np.linalg.slogdet(v)[1] + n), beta, s


def search(d, y, outer, inner):
    """The greatest likelihood on grids that narrow."""
    low, high, best = np.array([-5.0, -5.0]), np.array([3.0, 3.0]), None
    for _ in range(7):
        axes = [np.linspace(lo, hi, 7) for lo, hi in zip(low, high, strict=True)]
        points = [(a, b) for a in axes[0] for b in axes[1]]
        found = max((dense(d, y, outer, inner, *(0.0 if t <= -5 else 10**t for t in p)) + (p,) for p in points), key=lambda r: r[0])
        best = found if best is None or found[0] > best[0] else best
        step = (high - low) / 6
        low, high = np.maximum(np.array(best[3]) - 1.2 * step, -5), np.array(best[3]) + 1.2 * step
    return best


def test_likelihood_at_given_ratios(spark):
    outer, inner, x, z, y = sample(6, 4, 2, 5)
    data = mixed.group_sums(frame(spark, outer, inner, x, z, y), {"x": F.col("x")}, "y", "o", "i")
    points = np.array([[(-5.0, -5.0), (-0.15, -0.5), (0.4, -5.0)]])
    got = mixed._evaluate(data, points, np.arange(1), None, None)[0]
    d = np.column_stack([np.ones(len(x)), x])
    assert np.allclose(got, [dense(d, y, outer, inner, *mixed._ratios(p))[0] for p in points[0]])


@pytest.mark.parametrize(("outer_sd", "inner_sd"), [(0.8, 0.4), (0.0, 0.5), (0.0, 0.0)])
def test_fit_against_dense_search(spark, outer_sd, inner_sd):
    outer, inner, x, z, y = sample(3, 8, 3, 4, outer_sd, inner_sd)
    fit = mixed.mixed_model(frame(spark, outer, inner, x, z, y), {"x": F.col("x"), "z": F.col("z")}, "y", "o", "i")
    want = search(np.column_stack([np.ones(len(x)), x, z]), y, outer, inner)
    assert fit.log_likelihood >= want[0] - 1e-4 and np.allclose(fit.beta, want[1], atol=2e-3)
    assert math.isclose(fit.variances[2], want[2], rel_tol=0.02) and (fit.rows, fit.outer_groups, fit.inner_groups) == (96, 8, 24)


def test_resamples_equal_refits_of_repeated_clusters(spark):
    outer, inner, x, z, y = sample(9, 7, 2, 4)
    df = frame(spark, outer, inner, x, z, y)
    data = mixed.group_sums(df, {"x": F.col("x")}, "y", "o", "i")
    fits = np.arange(4)
    points = np.full((4, 1, 2), (-0.2, -0.7))
    got = mixed._evaluate(data, points, fits, 77, None, last=True)
    for k in fits:
        times = {}
        for c in range(7):
            drawn = np.random.default_rng([77, zlib.crc32(str(c).encode())]).poisson(1.0, size=4)
            times[c] = 1 if k == 0 else int(drawn[k])
        picks = [(c, t, np.flatnonzero(outer == c)) for c in range(7) for t in range(times[c])]
        rows = np.concatenate([r for *_, r in picks])
        o = np.concatenate([[n] * len(r) for n, (_, _, r) in enumerate(picks)])
        i = np.concatenate([n * 1000 + inner[r] for n, (_, _, r) in enumerate(picks)])
        want = dense(np.column_stack([np.ones(len(rows)), x[rows]]), y[rows], o, i, 10**-0.2, 10**-0.7)
        assert np.isclose(got[k, 0], want[0]) and np.allclose(got[k, 7:9], want[1]) and got[k, 1] == len(rows)


def test_drawn_responses_have_the_moments_of_the_model(spark):
    outer, inner, x, z, y = sample(5, 12, 3, 5)
    fit, betas = mixed.drawn_coefficients(frame(spark, outer, inner, x, z, y), {"x": F.col("x")}, "y", "o", "i", replicas=300, seed=3)
    assert betas.shape == (300, 2) and np.isfinite(betas).all(axis=1).mean() > 0.9
    sound = betas[np.isfinite(betas).all(axis=1)]
    # the refits scatter around the coefficients as the errors say
    assert np.allclose(sound.mean(axis=0), fit.beta, atol=0.15) and np.allclose(sound.std(axis=0), fit.errors, rtol=0.3)


def test_added_terms(spark):
    outer, inner, x, z, y = sample(8, 12, 3, 5)
    df = frame(spark, outer, inner, x, z, y)
    useful = mixed.added_fit(df, {"z": F.col("z")}, {"x": F.col("x")}, "y", "o", "i", replicas=40)
    assert useful["delta_r2"] > 0.05 and useful["p"] < 1e-4 and useful["low"] <= useful["delta_r2"] * 1.5 and useful["attempts"] == 40 and useful["success"] >= 28
    assert useful["extended_aic"] < useful["base_aic"] and useful["rows"] == 180
    with pytest.raises(ValueError):
        mixed.mixed_model(df.where("false"), {}, "y", "o", "i")


def test_steps_read_cells_not_groups(spark):
    outer, inner, x, z, y = sample(4, 3, 20, 5)
    keep = ~((inner % 2 == 1) & (np.arange(len(inner)) % 5 == 0))  # groups of five and of four rows
    data = mixed.group_sums(frame(spark, outer[keep], inner[keep], x[keep], z[keep], y[keep]), {"x": F.col("x"), "z": F.col("z")}, "y", "o", "i")
    assert data.groups.count() == 60 and sorted((r.outer, r.n, r.many) for r in data.cells.collect()) == [(str(o), n, 10.0) for o in range(3) for n in (4.0, 5.0)]
    some = data.only(["z"])
    points = np.array([[(-0.3, -0.6)]])
    d = np.column_stack([np.ones(len(z)), z])[keep]
    assert np.isclose(mixed._evaluate(some, points, np.arange(1), None, None)[0, 0], dense(d, y[keep], outer[keep], inner[keep], *mixed._ratios(points[0, 0]))[0])


def test_draws_are_made_once_and_added_up(spark):
    outer, inner, x, z, y = sample(2, 3, 6, 4)
    data = mixed.group_sums(frame(spark, outer, inner, x, z, y), {"x": F.col("x")}, "y", "o", "i")
    draw = (np.array([1.0, 0.5]), (0.5, 0.2, 0.4))
    drawn = mixed._with_draws(data, 4, 5, draw)
    rows = data.groups.collect()
    for cell in drawn.cells.collect():
        each = [mixed._drawn([r.outer], [r.inner], np.array([r.sums]), np.array([r.cross]), 4, 5, draw)[0] for r in rows if r.outer == cell.outer]
        assert len(each) == cell.many == 6 and np.allclose(np.frombuffer(cell.drawn).reshape(4, -1), sum(each))
    # a replica keeps its response whichever others are still on their way
    points = np.full((4, 1, 2), (-0.2, -0.7))
    whole = mixed._evaluate(drawn, points, np.arange(4), 5, draw)
    assert np.allclose(mixed._evaluate(drawn, points[:2], np.arange(2), 5, draw), whole[:2])


def test_added_terms_read_the_data_once(spark, monkeypatch):
    outer, inner, x, z, y = sample(8, 4, 3, 5)
    df, asked, made = frame(spark, outer, inner, x, z, y), [], mixed.group_sums
    monkeypatch.setattr(mixed, "group_sums", lambda *a: asked.append(a) or made(*a))
    found = mixed.added_fit(df, {"z": F.col("z")}, {"x": F.col("x")}, "y", "o", "i", replicas=2)
    monkeypatch.undo()
    assert len(asked) == 1 and math.isclose(found["base_aic"], mixed.mixed_model(df, {"z": F.col("z")}, "y", "o", "i").aic, rel_tol=1e-9)
