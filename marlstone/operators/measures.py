"""Grouped statistics, scaling and regression from sums that Spark aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.staging import stage_table


#: Values of a group that may be sorted together; intervals of one pass over larger groups.
TOGETHER, INTERVALS = 10_000, 1024
_MOST = 1.7976931348623157e308


def _finite(c: Column) -> Column:
    """Half of a value within the doubles, so that differences stay there too."""
    return F.least(F.greatest(c, F.lit(-_MOST)), F.lit(_MOST)) / 2


def _narrowed(data: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Targets ``keys, _rank, _lo, _hi, _n`` (the rank counted among the ``_n`` values from ``_lo`` to ``_hi``) with the one interval of ``INTERVALS`` in which each rank lies."""
    at = F.floor((_finite(F.col("_v")) - _finite(F.col("_lo"))) / (_finite(F.col("_hi")) - _finite(F.col("_lo"))) * INTERVALS)
    met = data.join(F.broadcast(targets), list(keys)).where("_v between _lo and _hi")
    counts = met.groupBy(*keys, "_point", "_rank", F.least(at, F.lit(INTERVALS - 1)).alias("_i")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # a target has no more than INTERVALS rows here
    ahead = F.sum("_n").over(Window.partitionBy(*keys, "_point").orderBy("_i")) - F.col("_n")
    return counts.withColumn("_ahead", ahead).where("_rank >= _ahead and _rank < _ahead + _n").select(*keys, "_point", (F.col("_rank") - F.col("_ahead")).alias("_rank"), "_lo", "_hi", "_n")


def _ranked(df: DataFrame, keys: Sequence[str], column: str, points: Sequence[float]) -> DataFrame:
    """``keys, n, values``: number of values of each group and its quantiles, exact and linear between ranks; nulls and NaN are left out, groups without a value have null.

    Values of a small group are sorted together. In a group of more than ``TOGETHER`` values the wanted ranks are narrowed to intervals by counts, pass
    by pass, until few or equal values are left; the counts are pre-aggregated, so no task holds a share of a group. Such
    groups are at most one for ``TOGETHER`` rows.
    """
    if not keys:
        return _ranked(df.withColumn("_one", F.lit(0)), ["_one"], column, points).drop("_one")
    data = df.select(*keys, F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).alias("_v"))
    # rows without a value stand for their group
    sizes = stage_table(data.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes")
    sound = data.where("_v is not null")
    spots = F.array(*[F.struct(F.lit(k).alias("_point"), F.lit(float(q)).alias("_q")) for k, q in enumerate(points)])
    large = sizes.where(F.col("n") > TOGETHER)
    place = F.col("_q") * (F.col("n") - 1)
    ends = F.array(F.floor(place), F.ceil(place))
    wanted = large.select(*keys, "n", "_lo", "_hi", F.inline(spots)).select(*keys, "_lo", "_hi", F.col("n").alias("_n"), F.posexplode(ends).alias("_end", "_rank"), (F.col("_point") * 2).alias("_point"))
    targets = stage_table(wanted.select(*keys, (F.col("_point") + F.col("_end")).alias("_point"), "_rank", "_lo", "_hi", "_n"), "targets")
    done = targets.where(F.lit(False))
    while not targets.isEmpty():
        open_ones = (F.col("_n") > TOGETHER) & (F.col("_lo") < F.col("_hi"))
        done = done.unionByName(targets.where(~open_ones))
        targets = stage_table(_narrowed(sound, targets.where(open_ones), keys), "targets")
    few = sound.join(F.broadcast(done.where("_lo < _hi")), list(keys)).where("_v between _lo and _hi").groupBy(*keys, "_point", "_rank").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    found = few.select(*keys, "_point", F.get("_all", F.col("_rank").cast("int")).alias("_v")).unionByName(done.where("_lo = _hi").select(*keys, "_point", F.col("_lo").alias("_v")))
    picked = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_point") == k, F.col("_v"))).alias(f"_e{k}") for k in range(2 * len(points))])

    def between(n: Column, low: Callable[[int], Column], high: Callable[[int], Column]) -> Column:
        each = []
        for k, q in enumerate(points):
            at = F.lit(float(q)) * (n - 1)
            each.append(F.when(F.floor(at) == F.ceil(at), low(k)).otherwise((F.ceil(at) - at) * low(k) + (at - F.floor(at)) * high(k)))
        return F.array(*each)

    of_large = large.join(picked, list(keys)).select(*keys, "n", between(F.col("n"), lambda k: F.col(f"_e{2 * k}"), lambda k: F.col(f"_e{2 * k + 1}")).alias("values"))
    small = sound.join(F.broadcast(large.select(*keys)), list(keys), "left_anti").groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    small = small.withColumn("n", F.size("_all").cast("long"))

    def at(which: Callable[[Column], Column]) -> Callable[[int], Column]:
        return lambda k: F.get("_all", which(F.lit(float(points[k])) * (F.col("n") - 1)).cast("int"))

    of_small = small.select(*keys, "n", between(F.col("n"), at(F.floor), at(F.ceil)).alias("values"))
    none = sizes.where("n = 0").select(*keys, "n", F.lit(None).cast("array<double>").alias("values"))
    return of_large.unionByName(of_small).unionByName(none)


def group_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form: ``keys, metric, median, n`` with the number of values that are neither null nor NaN."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("_value")) for c in columns])
    return _ranked(df.select(*keys, F.inline(cells)), [*keys, "metric"], "_value", [0.5]).select(*keys, "metric", F.get("values", F.lit(0)).alias("median"), "n")


def quantiles(df: DataFrame, keys: Sequence[str], column: str, points: Sequence[float]) -> DataFrame:
    """Exact quantiles, linear between ranks: ``keys, quantiles``."""
    return _ranked(df, keys, column, points).select(*keys, F.col("values").alias("quantiles"))


def complete_cases(df: DataFrame, present: Sequence[str], positive: Sequence[str] = (), named: Sequence[str] = ()) -> DataFrame:
    """Rows in which all numbers of ``present`` are there, all of ``positive`` are there and above 0, and no text of ``named`` is blank."""
    out = df
    for c in [*present, *positive]:
        out = out.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    for c in positive:
        out = out.where(F.col(c) > 0)
    for c in named:
        out = out.where(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    return out


def min_max(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each column scaled to 0..1 within its group (over all rows without keys); a constant one becomes 0.5."""
    ends = df.groupBy(*keys).agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("_lo", F.min), ("_hi", F.max))])
    out = df.join(ends, list(keys)) if keys else df.join(F.broadcast(ends))  # one row where there are no keys
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(c, F.when(F.col(c).isNull(), None).when(span == 0, 0.5).otherwise((F.col(c) - F.col(f"_lo_{c}")) / span))
    return out.select(*df.columns)


def z_score(df: DataFrame, column: str, name: str, keys: Sequence[str] = (), on_constant: str = "null") -> DataFrame:
    """Sample z-score within a group. A constant or single-row group gives null, 0 (``zero``), the distance itself (``one``) or an error (``raise``)."""
    stats = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    out = df.join(stats, list(keys)) if keys else df.join(F.broadcast(stats))
    flat = F.coalesce(F.col("_s") == 0, F.lit(True)) | F.isnan("_s")
    z = (F.col(column) - F.col("_m")) / F.col("_s")
    other = {"null": F.lit(None).cast("double"), "zero": F.lit(0.0), "one": F.col(column) - F.col("_m")}
    value = F.raise_error(F.lit(f"{column} is constant")).cast("double") if on_constant == "raise" else other[on_constant]
    return out.withColumn(name, F.when(flat, value).otherwise(z)).drop("_m", "_s")


def pivot_last(df: DataFrame, row: str, column: str, value: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Long to matrix: one column for each label in ``columns``; the last value in order counts, unknown labels are left out."""
    picks = [F.max_by(value, F.when(F.col(column) == c, F.col(order))).alias(c) for c in columns]
    return df.groupBy(row).agg(*picks)


def spline_basis(x: Column, knots: Sequence[float]) -> list[Column]:
    """Restricted cubic spline terms beyond the linear one: linear outside the outer knots."""

    def cube(k: float) -> Column:
        return F.pow(F.greatest(x - F.lit(float(k)), F.lit(0.0)), 3)

    last, before = float(knots[-1]), float(knots[-2])
    span = float(knots[-1] - knots[0]) ** 2
    return [(cube(k) - cube(before) * ((last - k) / (last - before)) + cube(last) * ((before - k) / (last - before))) / span for k in knots[:-2]]


def one_hot(c: Column, levels: Sequence[str]) -> list[Column]:
    """0/1 columns for all levels but the first."""
    return [F.when(c == level, 1.0).otherwise(0.0) for level in levels[1:]]


@dataclass
class Fit:
    """Least squares: coefficients, robust (HC3) errors, R squared, rows and residual degrees of freedom."""

    names: list[str]
    beta: np.ndarray
    errors: np.ndarray
    r2: float
    rows: int
    residual_df: int
    covariance: np.ndarray | None = None
    sse: float = float("nan")
    sst: float = float("nan")
    cross: np.ndarray | None = None


def _moments(df: DataFrame, design: list[Column], y: Column) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    p = len(design)
    cells = [F.sum(design[i] * design[j]) for i in range(p) for j in range(i, p)] + [F.sum(d * y) for d in design] + [F.sum(y * y), F.sum(y), F.count("*")]
    row = list(df.agg(*[c.alias(f"c{k}") for k, c in enumerate(cells)]).first())  # p*(p+3)/2 + 3 numbers
    row = [float(v or 0) for v in row]
    xx = np.zeros((p, p))
    xx[np.triu_indices(p)] = row[: p * (p + 1) // 2]
    xx = xx + xx.T - np.diag(np.diag(xx))
    return xx, np.array(row[p * (p + 1) // 2 : -3]), row[-3], row[-2], int(row[-1])


def least_squares(df: DataFrame, terms: dict[str, Column], y: str, robust: bool = True) -> Fit:
    """Ordinary least squares with an intercept over complete rows, HC3 errors with leverages kept below 1 by 1e-6.

    Two passes over the data: sums of products, then the robust middle matrix with
    the inverse as literals. Only matrices of the design's width reach the driver.
    """
    names = ["intercept", *terms]
    data = df.select(F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_x0"), *[c.cast("double").alias(f"_x{i + 1}") for i, c in enumerate(terms.values())]).na.drop()
    design = [F.col(f"_x{i}") for i in range(len(names))]
    xx, xy, yy, total, n = _moments(data, design, F.col("_y"))
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    sse = max(0.0, yy - float(beta @ xy))
    sst = yy - total**2 / max(n, 1)
    errors, covariance = np.full(len(names), np.nan), None
    if robust and n > len(names):
        at = F.array(*design)
        fitted = sum((design[i] * float(b) for i, b in enumerate(beta)), F.lit(0.0))
        leverage = sum((design[i] * sum((design[j] * float(inverse[i, j]) for j in range(len(names))), F.lit(0.0)) for i in range(len(names))), F.lit(0.0))
        scaled = data.withColumn("_w", F.pow((F.col("_y") - fitted) / F.greatest(1 - leverage, F.lit(1e-6)), 2)).withColumn("_at", at)
        middle = np.zeros_like(xx)
        cells = [F.sum(F.col("_w") * design[i] * design[j]).alias(f"c{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
        middle[np.triu_indices(len(names))] = [float(v or 0) for v in scaled.agg(*cells).first()]
        middle = middle + middle.T - np.diag(np.diag(middle))
        covariance = inverse @ middle @ inverse
        errors = np.sqrt(np.maximum(0, np.diag(covariance)))
    return Fit(names, beta, errors, 1 - sse / sst if sst > 0 else float("nan"), n, n - int(np.linalg.matrix_rank(xx)), covariance, sse, sst, xx)


def drop_one_block(df: DataFrame, blocks: dict[str, dict[str, Column]], y: str) -> dict[str, float]:
    """What R squared loses when one block of terms is left out; rows complete in all blocks count throughout."""
    every = {k: c for b in blocks.values() for k, c in b.items()}
    complete = df.where(F.lit(True))
    for c in every.values():
        complete = complete.where(c.isNotNull())
    full = least_squares(complete, every, y, robust=False).r2
    return {name: full - least_squares(complete, {k: c for k, c in every.items() if k not in blocks[name]}, y, robust=False).r2 for name in blocks}


def block_contributions(df: DataFrame, blocks: dict[str, dict[str, Column]], y: str, least: int = 10) -> list[dict[str, float]]:
    """For each block of terms ``delta_r2`` (what R squared loses without it), ``partial_r2`` (the share of the reduced model's error that it explains) and ``relative_pct`` (its share of all losses).

    Rows complete in all blocks count throughout; fewer than ``least`` of them give no result.
    """
    every = {k: c for b in blocks.values() for k, c in b.items()}
    complete = df.where(F.col(y).isNotNull())
    for c in every.values():
        complete = complete.where(c.isNotNull())
    full = least_squares(complete, every, y, robust=False)
    if full.rows < least:
        return []
    out = []
    for name in blocks:
        reduced = least_squares(complete, {k: c for k, c in every.items() if k not in blocks[name]}, y, robust=False)
        lost = max(0.0, reduced.sse - full.sse)
        out.append({"block": name, "delta_r2": lost / full.sst if full.sst > 0 else 0.0, "partial_r2": lost / reduced.sse if reduced.sse > 0 else 0.0})
    total = sum(r["delta_r2"] for r in out)
    return [r | {"relative_pct": 100 * r["delta_r2"] / total if total > 0 else 0.0, "r2": full.r2, "rows": full.rows} for r in out]


def standardized_means(df: DataFrame, fit: Fit, scenarios: dict[str, dict[str, Column]], back: Callable[[float], float] = math.exp) -> list[dict[str, float]]:
    """For each scenario the mean of the model's predictions over all rows with some terms set to it, back-transformed, with a 1.96 interval.

    A scenario gives a Column for each term of the fit (levels or values fixed for all rows, the others as they are);
    the mean prediction is the coefficients times the mean design, so all scenarios cost one pass.
    """
    cells = [F.avg(c.cast("double")).alias(f"c{i}_{j}") for i, terms in enumerate(scenarios.values()) for j, c in enumerate(terms[n] for n in fit.names[1:])]
    means = np.array([float(v) for v in df.agg(*cells).first()]).reshape(len(scenarios), -1)
    out = []
    for name, mean in zip(scenarios, means, strict=True):
        at = np.append(1.0, mean)
        link, error = float(at @ fit.beta), math.sqrt(max(0.0, float(at @ fit.covariance @ at)))
        out.append({"scenario": name, "estimate": back(link), "low": back(link - 1.96 * error), "high": back(link + 1.96 * error)})
    return out


def parametric_bootstrap(fit: Fit, vector: Sequence[float], replicas: int = 1000, seed: int = 1009, points: Sequence[float] = (0.025, 0.975)) -> tuple[float, float]:
    """Interval of a linear function of the coefficients over refits to responses drawn from the model.

    Refitted coefficients of a Gaussian model depend on the draws through their cross
    products alone, which are drawn themselves; so no replica reads the data.
    """
    rng = np.random.default_rng(seed)
    sigma = math.sqrt(fit.sse / max(1, fit.residual_df))
    root = np.linalg.cholesky(np.linalg.pinv(fit.cross) + 1e-15 * np.eye(len(fit.beta)))
    draws = fit.beta + sigma * rng.normal(size=(replicas, len(fit.beta))) @ root.T
    low, high = np.quantile(draws @ np.asarray(vector, float), points)
    return float(low), float(high)
