"""Whether an effect is a straight line: restricted cubic splines in a mixed model, with the curve and its band."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import measures, mixed
from marlstone.staging import stage_table

#: Quantiles of the knots, of those of the finer spline, and of the ends of the curve.
KNOTS, FINER, SHOWN = (0.10, 0.50, 0.90), (0.05, 0.35, 0.65, 0.95), (0.025, 0.975)


@dataclass
class Curve:
    """Tests of the bend, and the effect of ``x`` against that of its median, with a band over replicas."""

    tests: dict[str, float]
    x: np.ndarray
    effect: np.ndarray
    low: np.ndarray
    high: np.ndarray


def spline_values(x: np.ndarray, knots: Sequence[float]) -> np.ndarray:
    """The columns of ``measures.spline_basis`` for given numbers."""
    x, k = np.asarray(x, float), [float(v) for v in knots]
    cube = [np.maximum(x - v, 0.0) ** 3 for v in k]
    last = k[-1] - k[-2]
    return np.column_stack([(cube[i] - cube[-2] * (k[-1] - k[i]) / last + cube[-1] * (k[-2] - k[i]) / last) / (k[-1] - k[0]) ** 2 for i in range(len(k) - 2)])


def bent_effect(
    df: DataFrame, x: str, base: dict[str, Column], y: str, outer: str, inner: str,
    grid: int = 100, replicas: int = 1000, seed: int = 1009, points: tuple[float, float] = (0.025, 0.975), least: float = 0.7,
) -> Curve:
    """Tests whether the effect of ``x`` on ``y`` bends, beside the terms ``base`` and nested random intercepts, and draws its curve.

    Rows complete in all columns count; ``x`` and ``y`` are standardised over these. A straight line is compared with a spline of
    three knots and one of four (likelihood ratio, P, Akaike's criterion). The curve is the spline's effect between
    the outer quantiles ``SHOWN`` less that at the median; its band holds the middle of refits to responses drawn from the spline model,
    and is NaN where fewer than ``least`` of them (ten at least) come to an end. Too few different values for the knots are an error.
    """
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(outer).isNotNull() & F.col(inner).isNotNull())
    for c in base.values():
        whole = whole.where(c.isNotNull())
    whole = whole.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(outer).alias("_o"), F.col(inner).alias("_i"), *[c.cast("double").alias(f"_b{k}") for k, c in enumerate(base.values())])
    # written, since the figures and every pass of the quantiles read it
    whole = stage_table(whole, "complete")
    stats = whole.agg(F.avg("_x"), F.stddev_samp("_x"), F.avg("_y"), F.stddev_samp("_y"), F.count("*")).first()
    if not stats[4] or not stats[1] or not stats[3]:
        raise ValueError(f"{x} or {y} does not vary")
    wanted = sorted({*KNOTS, *FINER, *SHOWN, 0.5})
    found = dict(zip(wanted, measures.quantiles(whole, [], "_x", wanted).first()["quantiles"], strict=True))
    scaled = {q: (v - stats[0]) / stats[1] for q, v in found.items()}
    knots, finer = [scaled[q] for q in KNOTS], [scaled[q] for q in FINER]
    if any(a >= b for k in (knots, finer) for a, b in zip(k, k[1:], strict=False)):
        raise ValueError(f"{x} has too few different values for its knots")
    scaled_rows = whole.withColumn("_x", (F.col("_x") - stats[0]) / stats[1]).withColumn("_y", (F.col("_y") - stats[2]) / stats[3])
    bends = {f"_{n}{k}": c for n, at in (("k", knots), ("f", finer)) for k, c in enumerate(measures.spline_basis(F.col("_x"), at))}
    # written, since every sum of products would compute its columns again
    data = stage_table(scaled_rows.withColumns(bends), "bends")
    terms = {f"_b{k}": F.col(f"_b{k}") for k in range(len(base))} | {"_x": F.col("_x")}
    # the sums of all three models at once
    sums = mixed.group_sums(data, terms | {c: F.col(c) for c in bends}, "_y", "_o", "_i")
    straight = mixed.fitted(sums.only([*terms]))
    spline, draws = mixed.drawn_from(sums.only([*terms, *(c for c in bends if c[1] == "k")]), replicas, seed)
    fine = mixed.fitted(sums.only([*terms, *(c for c in bends if c[1] == "f")]))
    statistic, p = mixed.likelihood_ratio(straight, spline, df)
    finer_statistic, finer_p = mixed.likelihood_ratio(straight, fine, df)
    ends = np.linspace(found[SHOWN[0]], found[SHOWN[1]], grid)
    z, middle = (ends - stats[0]) / stats[1], scaled[0.5]
    design = np.column_stack([z - middle, spline_values(z, knots) - spline_values([middle], knots)])
    at = len(base) + 1
    effect = design @ spline.beta[at:]
    sound = draws[np.isfinite(draws).all(axis=1)][:, at:]
    low = high = np.full(grid, np.nan)
    if len(sound) >= max(10, math.ceil(least * replicas)):
        low, high = np.quantile(sound @ design.T, points, axis=0)
    tests = {
        "rows": spline.rows, "outer_groups": spline.outer_groups, "inner_groups": spline.inner_groups, "statistic": statistic, "p": p, "straight_aic": straight.aic, "spline_aic": spline.aic,
        "finer_statistic": finer_statistic, "finer_p": finer_p, "finer_aic": fine.aic, "median": found[0.5], "attempts": replicas, "success": len(sound),
    }
    return Curve(tests, ends, effect, low, high)
