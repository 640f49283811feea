"""Linear mixed models with nested random intercepts, by maximum likelihood over aggregated sums.

The likelihood of a pair of variance ratios needs, for each inner group, its row count and the sums and
products of its columns; residual variance and coefficients follow from these (profile
likelihood). A group's weight depends on its row count alone, so inner groups of one outer group and one
count are added up before the first step: the steps read these cells, whose number within an outer group
is at most the root of twice its rows, however many inner groups there are. Many fits go side by side:
the whole data, cluster resamples, in which an outer group counts as often as it is drawn, and responses
drawn from a fitted model. Of these the group sums are drawn, once for all steps, by tasks that each have
a part of the inner groups, and are added up to cells as well; no replica reads a row of data. Each step of
the optimiser is one Spark job over the cells: tasks stream them in order, hold one outer group's sums
for all fits, and yield partial sums that are reduced fit by fit. A step is Newton's, with derivatives by
differences around the present point, kept inside a radius that shrinks where the likelihood falls.
The driver sees the likelihoods of the points and at last the coefficients of each fit.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import chi2_survival
from marlstone.staging import stage_table

#: Powers of ten of the variance ratios: the least stands for none; distance of the points of differences; the end of the steps.
LOWEST, HIGHEST, APART, NEAR, STEPS = -5.0, 3.0, 0.02, 1e-3, 40
#: Numbers held at once for a slice of groups.
CELLS = 2_000_000
_STENCIL = np.array([(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1)]) * APART


@dataclass
class MixedFit:
    """Coefficients, variances (outer, inner, residual), log-likelihood, marginal R squared and numbers of rows and groups."""

    names: list[str]
    beta: np.ndarray
    errors: np.ndarray
    variances: tuple[float, float, float]
    log_likelihood: float
    marginal_r2: float
    rows: int
    outer_groups: int
    inner_groups: int

    @property
    def aic(self) -> float:
        """Akaike's criterion; the three variances count as parameters."""
        return 2 * (len(self.names) + 3) - 2 * self.log_likelihood


@dataclass
class _Data:
    """Sums of the inner groups, and of the cells; ``cells`` may hold drawn responses too."""

    groups: DataFrame
    cells: DataFrame
    names: list[str]

    @property
    def p(self) -> int:
        return len(self.names)

    def only(self, names: Sequence[str]) -> _Data:
        """The sums of a model with the intercept and some of the terms, in their order here."""
        kept = [k for k, n in enumerate(self.names) if k == 0 or n in names] + [self.p]
        place = {pair: k for k, pair in enumerate(zip(*_upper(self.p + 1), strict=True))}
        pairs = [place[kept[i], kept[j]] for i, j in zip(*_upper(len(kept)), strict=True)]

        def picked(df: DataFrame) -> DataFrame:
            at = {"sums": kept, "moments": pairs, "cross": pairs}
            return df.select(*[F.array(*[F.get(c, F.lit(k)) for k in at[c]]).alias(c) if c in at else c for c in df.columns])

        return _Data(picked(self.groups), picked(self.cells), [self.names[k] for k in kept[:-1]])


#: What the responses of refits are drawn from: coefficients and variances.
_Draw = tuple[np.ndarray, tuple[float, float, float]]


def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n)


def group_sums(df: DataFrame, terms: dict[str, Column], y: str, outer: str, inner: str) -> _Data:
    """Sums and products of an intercept, the terms and ``y`` for each inner group, over complete rows, and of these for each cell; written."""
    names = ["intercept", *terms]
    columns = [F.lit(1.0), *[c.cast("double") for c in terms.values()], F.col(y).cast("double")]
    data = df.select(F.col(outer).cast("string").alias("outer"), F.col(inner).cast("string").alias("inner"), F.array(*columns).alias("_x"))
    data = data.where("outer is not null and inner is not null").where(F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)))
    n = len(columns)
    pairs = [*zip(*map(np.ndarray.tolist, _upper(n)), strict=True)]
    cells = [F.sum(F.col("_x")[i]).alias(f"s{i}") for i in range(n)] + [F.sum(F.col("_x")[i] * F.col("_x")[j]).alias(f"c{i}_{j}") for i, j in pairs]
    sums = data.groupBy("outer", "inner").agg(*cells)
    packed = sums.select("outer", "inner", F.array(*[f"s{i}" for i in range(n)]).alias("sums"), F.array(*[f"c{i}_{j}" for i, j in pairs]).alias("cross"))
    groups = stage_table(packed, "groups")
    s = F.col("sums")
    added = [F.sum(s[i]).alias(f"s{i}") for i in range(n)] + [F.sum(s[i] * s[j]).alias(f"m{i}_{j}") for i, j in pairs] + [F.sum(F.col("cross")[k]).alias(f"c{i}_{j}") for k, (i, j) in enumerate(pairs)]
    whole = groups.groupBy("outer", s[0].alias("n")).agg(F.count("*").cast("double").alias("many"), *added)
    arrays = {"sums": [f"s{i}" for i in range(n)], "moments": [f"m{i}_{j}" for i, j in pairs], "cross": [f"c{i}_{j}" for i, j in pairs]}
    return _Data(groups, stage_table(whole.select("outer", "n", "many", *[F.array(*c).alias(a) for a, c in arrays.items()]), "cells"), names)


def _generator(seed: int | None, *names: str) -> np.random.Generator:
    return np.random.default_rng([seed or 0, *(zlib.crc32(x.encode()) for x in names)])


def _drawn(outer: list[str], inner: list[str], sums: np.ndarray, cross: np.ndarray, many: int, seed: int, draw: _Draw) -> np.ndarray:
    """For each group and fit: the sum of the drawn response, that times the terms' sums, its square; the response's products with the terms, and with itself, over the rows."""
    beta, (of_outer, of_inner, of_row) = draw
    p, size = len(beta), len(inner)
    n, x, (i, j) = sums[:, 0], sums[:, :p], _upper(sums.shape[1])
    xx = np.zeros((size, p + 1, p + 1))
    xx[:, i, j] = xx[:, j, i] = cross
    xx = xx[:, :p, :p]
    values, vectors = np.linalg.eigh(xx)
    rank = (values > 1e-10 * np.maximum(values.max(axis=1), 1e-300)[:, None]).sum(axis=1)
    effects = {o: _generator(seed, o).normal(size=many) * math.sqrt(of_outer) for o in set(outer)}
    shift, z, rest = np.zeros((size, many)), np.zeros((size, many, p)), np.zeros((size, many))
    for k, (o, name) in enumerate(zip(outer, inner, strict=True)):
        rng, r = _generator(seed, o, name), rank[k]
        shift[k] = effects[o] + math.sqrt(of_inner) * rng.normal(size=many)
        z[k, :, p - r :] = rng.normal(size=(many, r))
        rest[k] = rng.chisquare(max(n[k] - r, 1e-9), size=many) * (n[k] > r)
    # products of the terms with the noise of the rows, and the square of that noise
    noise = math.sqrt(of_row) * z @ (vectors * np.sqrt(np.maximum(values, 0))[:, None, :]).transpose(0, 2, 1)
    rest = of_row * ((z * z).sum(axis=2) + rest)
    mean, fitted = x @ beta, xx @ beta
    response = mean[:, None] + n[:, None] * shift + noise[:, :, 0]
    mixed = fitted[:, None, :] + shift[:, :, None] * x[:, None, :] + noise
    squares = (fitted @ beta)[:, None] + 2 * shift * mean[:, None] + n[:, None] * shift**2 + 2 * (noise @ beta + shift * noise[:, :, 0]) + rest
    return np.concatenate([response[..., None], response[..., None] * x[:, None, :], response[..., None] ** 2, mixed, squares[..., None]], axis=2)


def _draws(many: int, seed: int, draw: _Draw) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Groups to parts of cells with what is drawn for them, in any order."""
    width = many * (3 + 2 * len(draw[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[str, float], np.ndarray] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, max(1, CELLS // width)):
                part = batch.slice(begin, max(1, CELLS // width))
                outer, inner = part.column(0).to_pylist(), part.column(1).to_pylist()
                sums, cross = (part.column(k).flatten().to_numpy(zero_copy_only=False).reshape(len(outer), -1) for k in (2, 3))
                found = _drawn(outer, inner, sums, cross, many, seed, draw).reshape(len(outer), -1)
                of: dict[tuple[str, float], list[int]] = {}
                for k, key in enumerate(zip(outer, sums[:, 0].tolist(), strict=True)):
                    of.setdefault(key, []).append(k)
                for key, rows in of.items():
                    cells[key] = cells.get(key, 0) + found[rows].sum(axis=0)
                if len(cells) * width > 2 * CELLS:
                    yield _parts(cells)
                    cells = {}
        if cells:
            yield _parts(cells)

    return run


def _parts(cells: dict[tuple[str, float], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o for o, _ in cells], pa.string()), pa.array([n for _, n in cells], pa.float64()), pa.array([v.tobytes() for v in cells.values()], pa.binary())], ["outer", "n", "drawn"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in the order of their cells, added up."""
    key, total = None, None
    for batch in batches:
        for outer, n, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (outer, n):
                if key is not None:
                    yield _parts({key: total})
                key, total = (outer, n), 0.0
            total = total + np.frombuffer(part)
    if key is not None:
        yield _parts({key: total})


def _with_draws(data: _Data, many: int, seed: int, draw: _Draw) -> _Data:
    """``data`` whose cells hold the sums of ``many`` drawn responses; written, so that every step of a fit sees the same ones."""
    schema = "outer string, n double, drawn binary"
    parts = data.groups.mapInArrow(_draws(many, seed, draw), schema)
    drawn = parts.repartition("outer", "n").sortWithinPartitions("outer", "n").mapInArrow(_added, schema)
    return replace(data, cells=stage_table(data.cells.join(drawn, ["outer", "n"]), "drawn"))


class _Cluster:
    """Sums of one outer group for all points of all fits."""

    def __init__(self, name: str, p: int, ratios: np.ndarray, fits: np.ndarray, seed: int | None) -> None:
        self.name, self.p, self.seed, self.fits = name, p, seed, fits
        self.a, self.b = ratios[..., 0].ravel(), ratios[..., 1].ravel()
        self.each = ratios.shape[1]
        many, pairs = len(self.a), (p + 1) * (p + 2) // 2
        self.log, self.weight = np.zeros(many), np.zeros(many)
        self.t, self.q = np.zeros((many, p + 1)), np.zeros((many, pairs))
        self.rows, self.cross = 0.0, np.zeros((len(fits), pairs))

    def add(self, n: np.ndarray, many: np.ndarray, sums: np.ndarray, moments: np.ndarray, cross: np.ndarray, drawn: np.ndarray | None) -> None:
        """Cells of ``many`` groups of ``n`` rows each; ``drawn`` is what ``_drawn`` says, by cell and fit."""
        p, (i, j) = self.p, _upper(self.p + 1)
        d = 1 / (1 + n[:, None] * self.b)
        self.log -= many @ np.log(d)
        self.weight += (n * many) @ d
        self.rows += n @ many
        if drawn is None:
            self.t += d.T @ sums
            self.q += (self.b * d).T @ moments
            self.cross += cross.sum(axis=0)
            return
        shape = (len(n), len(self.fits), self.each)
        bd = self.b * d
        self.t[:, :p] += d.T @ sums[:, :p]
        self.t[:, p] += (d * np.repeat(drawn[:, :, 0], self.each, axis=1)).sum(axis=0)
        of_x = j < p
        self.q[:, of_x] += bd.T @ moments[:, of_x]
        self.q[:, (j == p) & (i < p)] += np.einsum("cfe,cfp->fep", bd.reshape(shape), drawn[:, :, 1 : 1 + p]).reshape(-1, p)
        self.q[:, (j == p) & (i == p)] += (bd * np.repeat(drawn[:, :, 1 + p], self.each, axis=1)).sum(axis=0)[:, None]
        self.cross[:, of_x] += cross[:, of_x].sum(axis=0)
        self.cross[:, (j == p) & (i < p)] += drawn[:, :, 2 + p : 2 + 2 * p].sum(axis=0)
        self.cross[:, (j == p) & (i == p)] += drawn[:, :, 2 + 2 * p].sum(axis=0)[:, None]

    def drawn_times(self) -> np.ndarray:
        """How often each fit takes this outer group: once, or a Poisson number; the fit 0 is the whole."""
        if self.seed is None:
            return np.ones(len(self.fits))
        times = _generator(self.seed, self.name).poisson(1.0, size=int(self.fits.max()) + 1).astype(float)
        times[0] = 1
        return times[self.fits]

    def close(self, total: np.ndarray, whole: np.ndarray) -> None:
        i, j = _upper(self.p + 1)
        times = self.drawn_times()
        share = self.a / (1 + self.a * self.weight)
        often = np.repeat(times, self.each)[:, None]
        total += often * np.column_stack([self.log + np.log1p(self.a * self.weight), self.q + share[:, None] * self.t[:, i] * self.t[:, j]])
        whole += times[:, None] * np.column_stack([np.full(len(times), self.rows), self.cross])


def _ratios(theta: np.ndarray) -> np.ndarray:
    return np.where(theta <= LOWEST, 0.0, 10.0**theta)


def _partials(p: int, theta: np.ndarray, fits: np.ndarray, seed: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, pairs = _ratios(theta), (p + 1) * (p + 2) // 2
        total, whole, now = np.zeros((ratios.shape[0] * ratios.shape[1], 1 + pairs)), np.zeros((len(fits), 1 + pairs)), None
        most = max(1, CELLS // (len(total) * (p + 1)))
        for batch in batches:
            outer = batch.column(0).to_pylist()
            n, many = (batch.column(k).to_numpy() for k in (1, 2))
            sums, moments, cross = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(len(outer), -1) for k in (3, 4, 5))
            begin = 0
            while begin < len(outer):
                stop = begin
                while stop < len(outer) and stop < begin + most and outer[stop] == outer[begin]:
                    stop += 1
                if now is None or now.name != outer[begin]:
                    if now is not None:
                        now.close(total, whole)
                    now = _Cluster(outer[begin], p, ratios, fits, seed)
                drawn = None
                if batch.num_columns > 6:
                    drawn = np.stack([np.frombuffer(b).reshape(-1, 3 + 2 * p)[fits] for b in batch.column(6).slice(begin, stop - begin).to_pylist()])
                now.add(n[begin:stop], many[begin:stop], sums[begin:stop], moments[begin:stop], cross[begin:stop], drawn)
                begin = stop
        if now is None:
            return
        now.close(total, whole)
        parts = np.concatenate([whole.reshape(len(fits), -1), total.reshape(len(fits), -1)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(fits.astype(np.int32)), pa.array([row.tobytes() for row in parts], pa.binary())], ["fit", "part"])

    return run


def _matrix(cells: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[_upper(n)] = cells
    return out + np.triu(out, 1).T


def _solved(whole: np.ndarray, point: np.ndarray, p: int) -> tuple[float, np.ndarray, np.ndarray, float, int]:
    """Log-likelihood, coefficients, inverse, residual variance and rank at one point."""
    n = whole[0]
    left = _matrix(whole[1:] - point[1:], p + 1)
    inverse = np.linalg.pinv(left[:p, :p], hermitian=True)
    beta = inverse @ left[:p, p]
    variance = max(float(left[p, p] - beta @ left[:p, p]) / max(n, 1), 1e-300)
    return -0.5 * (n * math.log(2 * math.pi * variance) + point[0] + n), beta, inverse, variance, int(np.linalg.matrix_rank(left[:p, :p], hermitian=True))


def _reduce(p: int, each: int, theta: np.ndarray | None, fits: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """Partial sums of one fit to the likelihood of its points, or, given the one point, to all that is known of the fit there."""

    def run(rows: pa.Table) -> pa.Table:
        fit = rows["fit"][0].as_py()
        summed = sum(np.frombuffer(b) for b in rows["part"].to_pylist())
        pairs = (p + 1) * (p + 2) // 2
        whole, points = summed[: 1 + pairs], summed[1 + pairs :].reshape(each, 1 + pairs)
        solved = [_solved(whole, x, p) for x in points]
        if theta is None:
            values = [s[0] for s in solved]
        else:
            likelihood, beta, inverse, variance, rank = solved[0]
            a, b = _ratios(theta[list(fits).index(fit), 0])
            n, products = whole[0], _matrix(whole[1:], p + 1)[:p, :p]
            # with the sample's degrees of freedom, as of a computed column of predictions
            fixed = float(beta @ products @ beta - (beta @ products[0]) ** 2 / n) / max(n - 1, 1)
            every = fixed + variance * (1 + a + b)
            values = [likelihood, n, rank, a * variance, b * variance, variance, fixed / every if every > 0 else math.nan, *beta, *np.sqrt(np.maximum(0, np.diag(inverse) * variance))]
        return pa.table([pa.array([fit], pa.int32()), pa.array([values], pa.list_(pa.float64()))], ["fit", "found"])

    return run


def _evaluate(data: _Data, theta: np.ndarray, fits: np.ndarray, seed: int | None, draw: _Draw | None, last: bool = False) -> np.ndarray:
    """For each fit the likelihoods at its points ``theta`` (fits, points, 2); with ``last`` what ``_reduce`` says of its one point. Fits without data have NaN.

    With ``draw`` the cells hold drawn responses (``_with_draws``), else outer groups are drawn where there is a seed.
    """
    # an outer group is whole and in order in one task, which streams it
    ordered = data.cells.repartition("outer").sortWithinPartitions("outer", "n")
    parts = ordered.mapInArrow(_partials(data.p, theta, fits, None if draw else seed), "fit int, part binary")
    found = parts.groupBy("fit").applyInArrow(_reduce(data.p, theta.shape[1], theta if last else None, fits), "fit int, found array<double>").collect()  # a row for each fit
    out = np.full((len(fits), 7 + 2 * data.p if last else theta.shape[1]), np.nan)
    place = {int(f): k for k, f in enumerate(fits)}
    for row in found:
        out[place[row.fit]] = row.found
    return out


def _optimise(data: _Data, start: np.ndarray, seed: int | None = None, draw: _Draw | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best point found for each fit, and whether its steps came to an end."""
    best, radius = start.copy(), np.ones(len(start))
    value, step = np.full(len(start), -np.inf), np.zeros_like(start)
    slopes, bends = np.zeros_like(start), np.zeros((len(start), 2, 2))
    active = np.arange(len(start))
    for _ in range(STEPS):
        trial = np.clip(best[active] + step[active], LOWEST, HIGHEST)
        found = _evaluate(data, trial[:, None, :] + _STENCIL, active, seed, draw)
        better = found[:, 0] >= value[active] - 1e-10
        for row, k in enumerate(active):
            if not better[row]:
                radius[k] = 0.25 * min(radius[k], float(np.abs(step[k]).max()))
                continue
            f = found[row]
            best[k], value[k], radius[k] = trial[row], f[0], min(2.0, 1.5 * radius[k])
            slopes[k] = (f[1] - f[2]) / (2 * APART), (f[3] - f[4]) / (2 * APART)
            cross = (f[5] - f[1] - f[3] + f[0]) / APART**2
            bends[k] = [[(f[1] - 2 * f[0] + f[2]) / APART**2, cross], [cross, (f[3] - 2 * f[0] + f[4]) / APART**2]]
        for k in active:
            step[k] = _newton(best[k], slopes[k], bends[k], radius[k])
        done = ~np.isfinite(value[active]) | (np.abs(step[active]).max(axis=1) < NEAR)
        active = active[~done]
        if not len(active):
            break
    ended = np.ones(len(start), bool)
    ended[active] = False
    return best, ended & np.isfinite(value)


def _newton(at: np.ndarray, slope: np.ndarray, bend: np.ndarray, radius: float) -> np.ndarray:
    """A step uphill within a radius. A ratio at an end that it would leave stands still."""
    free = ~((at <= LOWEST) & (slope <= 1e-9) | (at >= HIGHEST) & (slope >= -1e-9))
    step = np.zeros(2)
    if not free.any() or not np.isfinite(slope).all():
        return step
    values, vectors = np.linalg.eigh(bend[np.ix_(free, free)])
    along = vectors.T @ slope[free]
    # against a bend that is not downhill, as far as the radius goes
    moved = np.where(values < -1e-6, -along / np.minimum(values, -1e-6), np.sign(along) * radius * (np.abs(along) > 1e-5))
    step[free] = vectors @ moved
    size = float(np.abs(step).max())
    return step * min(1.0, radius / size) if size > 0 else step


def _start(data: _Data) -> np.ndarray:
    """The best of a few points for the whole data."""
    points = np.array([(x, y) for x in (-3.0, -1.0, 0.0, 1.0) for y in (-3.0, -1.0, 0.0, 1.0)])
    found = _evaluate(data, points[None], np.arange(1), None, None)[0]
    if np.isnan(found).any():
        raise ValueError("no complete rows to fit")
    return points[[int(np.argmax(found))]]


def _fit(data: _Data) -> tuple[MixedFit, np.ndarray]:
    at, _ = _optimise(data, _start(data))
    values = _evaluate(data, at[:, None, :], np.arange(1), None, None, last=True)[0]
    counts = data.cells.agg(F.countDistinct("outer"), F.sum("many")).first()
    p = data.p
    return MixedFit(data.names, values[7 : 7 + p], values[7 + p :], tuple(values[3:6]), values[0], values[6], int(values[1]), counts[0], int(counts[1])), at


def mixed_model(df: DataFrame, terms: dict[str, Column], y: str, outer: str, inner: str) -> MixedFit:
    """``y`` on an intercept and terms, with random intercepts for ``outer`` and for ``inner`` within it; complete rows count, none are an error."""
    return _fit(group_sums(df, terms, y, outer, inner))[0]


def likelihood_ratio(small: MixedFit, large: MixedFit, df: DataFrame) -> tuple[float, float]:
    """Statistic and P of two nested fits; one or two degrees of freedom. ``df`` lends its session."""
    degrees = len(large.names) - len(small.names)
    statistic = max(0.0, 2 * (large.log_likelihood - small.log_likelihood))
    return statistic, float(df.sparkSession.range(1).select(chi2_survival(F.lit(statistic), degrees)).first()[0])


def _refits(data: _Data, at: np.ndarray, replicas: int, seed: int, draw: _Draw | None = None) -> np.ndarray:
    """What ``_reduce`` says of each replica, NaN where its steps did not end or its terms depend on one another. Fit 0, the whole, is left out."""
    starts = np.repeat(at, replicas + 1, axis=0)
    data = _with_draws(data, replicas + 1, seed, draw) if draw else data
    best, ended = _optimise(data, starts, seed, draw)
    values = _evaluate(data, best[:, None, :], np.arange(replicas + 1), seed, draw, last=True)
    values[~ended | (values[:, 2] < data.p)] = np.nan
    return values[1:]


def _interval(draws: np.ndarray, replicas: int, points: tuple[float, float], least: float) -> tuple[float, float, int]:
    sound = draws[np.isfinite(draws)]
    if len(sound) < max(10, math.ceil(least * replicas)):
        return math.nan, math.nan, len(sound)
    return *(float(v) for v in np.quantile(sound, points)), len(sound)


def added_fit(df: DataFrame, base: dict[str, Column], more: dict[str, Column], y: str, outer: str, inner: str, replicas: int = 1000, seed: int = 1009, points: tuple[float, float] = (0.025, 0.975), least: float = 0.7) -> dict[str, float]:
    """What terms add to a model: gain of marginal R squared with an interval over refits of both models to cluster resamples, likelihood ratio and P.

    Rows complete in all terms count for both. Outer groups are drawn a Poisson(1) number of times. A resample fails where a
    fit does not end or its terms depend on one another; with successes under the share ``least`` (ten at least) there is no interval.
    """
    whole = df.where(F.col(y).isNotNull())
    for c in (*base.values(), *more.values()):
        whole = whole.where(c.isNotNull())
    # the sums of the larger model hold those of the smaller one
    every = group_sums(whole, {**base, **more}, y, outer, inner)
    sides = [every.only([*base]), every]
    (small, at_small), (large, at_large) = (_fit(d) for d in sides)
    drawn = [_refits(d, at, replicas, seed)[:, 6] for d, at in zip(sides, (at_small, at_large), strict=True)]
    low, high, success = _interval(drawn[1] - drawn[0], replicas, points, least)
    statistic, p = likelihood_ratio(small, large, df)
    gain = large.marginal_r2 - small.marginal_r2
    return {
        "rows": large.rows, "outer_groups": large.outer_groups, "inner_groups": large.inner_groups, "base_r2": small.marginal_r2, "extended_r2": large.marginal_r2,
        "delta_r2": gain, "partial_r2": gain / (1 - small.marginal_r2) if small.marginal_r2 < 1 else math.nan, "statistic": statistic, "p": p,
        "base_aic": small.aic, "extended_aic": large.aic, "low": low, "high": high, "attempts": replicas, "success": success,
    }


def fitted(data: _Data) -> MixedFit:
    """The model of sums that are there already (``group_sums``, ``only``)."""
    return _fit(data)[0]


def drawn_coefficients(df: DataFrame, terms: dict[str, Column], y: str, outer: str, inner: str, replicas: int = 1000, seed: int = 1009) -> tuple[MixedFit, np.ndarray]:
    """The fit, and the coefficients of refits to responses drawn from it, random intercepts and rows: a line for each replica, NaN where it failed."""
    return drawn_from(group_sums(df, terms, y, outer, inner), replicas, seed)


def drawn_from(data: _Data, replicas: int, seed: int) -> tuple[MixedFit, np.ndarray]:
    """``drawn_coefficients`` of sums that are there already."""
    fit, at = _fit(data)
    values = _refits(data, at, replicas, seed, (fit.beta, fit.variances))
    return fit, values[:, 7 : 7 + data.p]
