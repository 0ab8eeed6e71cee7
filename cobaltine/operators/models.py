"""Fitted forecasts: additive Holt-Winters, an ARIMA grid, and the routes that choose by length.

A series has one row per date, so its length is bounded by the calendar and a whole series
fits a task; rows are summed to dates (``series.demand_series``) before they come here.
Null quantities count as 0.  Fits depend on nothing but the values, so a task that is run
again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import ahead, flat_smoothing_forecast, per_series, trend_forecast
from .streamed import by_series, each_series, in_runs

#: values below it are raised to it before a fit
FLOOR = 0.01


def started(x: np.ndarray, period: int) -> tuple[float, float, np.ndarray]:
    """(level, trend, season) from the first cycles: mean, difference of the first two means, mean deviation of each position; without a season from the first two values."""
    if not period:
        return x[0] - (x[1] - x[0]), x[1] - x[0], np.zeros(1)
    cycles = x[: len(x) // period * period].reshape(-1, period)
    trend0 = (cycles[1].mean() - cycles[0].mean()) / period
    level0 = cycles[0].mean() - trend0 * (period + 1) / 2
    line = level0 + trend0 * np.arange(1, cycles.size + 1)
    return level0, trend0, (cycles.ravel() - line).reshape(-1, period).mean(0)


def filtered(xs: list[np.ndarray], grids: list[np.ndarray], period: int) -> list[tuple[np.ndarray, ...]]:
    """Runs the additive recursions of several series, longest first, for all parameter sets of each at once: (squared error, level, trend, season) a series.

    A period of 0 leaves the season out.  All sets of all series are one vector; what is still
    running is its front part, as the shorter series end first.
    """
    alpha, beta, gamma = np.concatenate(grids, axis=1)
    start = [started(x, period) for x in xs]
    ends = np.cumsum([g.shape[1] for g in grids])
    owner = np.repeat(np.arange(len(xs)), [g.shape[1] for g in grids])
    level, trend, error = (np.array(v)[owner] for v in ([s[0] for s in start], [s[1] for s in start], [0.0] * len(xs)))
    season = np.array([s[2] for s in start]).T[:, owner]
    ab, ga = alpha * beta, gamma * (1 - alpha)
    values = np.zeros((len(xs[0]), len(xs)))
    for i, x in enumerate(xs):
        values[: len(x), i] = x
    base, miss, part = (np.empty_like(level) for _ in range(3))
    t = 0
    for running in range(len(xs), 0, -1):
        n = ends[running - 1]
        l, b, e, a, c, g, o, base_, miss_, part_ = (v[:n] for v in (level, trend, error, alpha, ab, ga, owner, base, miss, part))
        seasons = [s[:n] for s in season]
        for t in range(t, len(xs[running - 1])):
            at = seasons[t % len(seasons)]
            np.add(l, b, out=base_)
            np.add(base_, at, out=part_)
            np.take(values[t], o, out=miss_, mode="clip")
            np.subtract(miss_, part_, out=miss_)
            np.multiply(miss_, miss_, out=part_)
            np.add(e, part_, out=e)
            np.multiply(a, miss_, out=part_)
            np.add(base_, part_, out=l)
            np.multiply(c, miss_, out=part_)
            np.add(b, part_, out=b)
            if period:
                np.multiply(g, miss_, out=part_)
                np.add(at, part_, out=at)
        t = len(xs[running - 1])
    cut = list(zip([0, *ends[:-1]], ends, strict=True))
    return [(error[i:j], level[i:j], trend[i:j], season[:, i:j]) for i, j in cut]


def holt_winters_many(xs: list[np.ndarray], horizon: int, period: int) -> list[np.ndarray]:
    """Forecasts of several series, each of the parameters with the least squared error on a grid that is narrowed three times."""
    out: list[np.ndarray] = [np.empty(0)] * len(xs)
    for own in (period, 0):
        which = sorted((i for i, x in enumerate(xs) if (period if len(x) >= 2 * period else 0) == own), key=lambda i: -len(xs[i]))
        if not which or (own == 0 and period == 0 and any(len(out[i]) for i in which)):
            continue
        group = [np.maximum(xs[i], FLOOR) for i in which]
        centres, width = [np.array([0.5, 0.5, 0.5])] * len(group), 0.5
        for _ in range(4):
            grids = []
            for centre in centres:
                axes = [np.unique(np.clip(c + np.linspace(-width, width, 7), 0.001, 0.999)) for c in centre[: 3 if own else 2]]
                grids.append(np.array(list(product(*axes, *([] if own else [[0.0]])))).T)
            found = filtered(group, grids, own)
            best = [int(np.argmin(f[0])) for f in found]
            centres, width = [g[:, k] for g, k in zip(grids, best, strict=True)], width / 3
        steps = np.arange(1, horizon + 1)
        for i, x, (_, level, trend, season), k in zip(which, group, found, best, strict=True):
            out[i] = level[k] + steps * trend[k] + season[(len(x) + steps - 1) % len(season), k]
    return out


def holt_winters_values(x: np.ndarray, horizon: int, period: int) -> np.ndarray:
    return holt_winters_many([x], horizon, period)[0]


def lags(x: np.ndarray, n: int, start: int) -> np.ndarray:
    """Columns x[t-1] .. x[t-n] of the rows t >= start."""
    return np.column_stack([x[start - i : len(x) - i] for i in range(1, n + 1)]) if n else np.empty((len(x) - start, 0))


def inside(coefficients: np.ndarray, most: float) -> bool:
    """Whether shocks fade: no root of z^n - c1 z^(n-1) .. is larger than ``most``."""
    n = len(coefficients)
    if not n:
        return True
    sizes = np.abs(coefficients)
    # two bounds tell most cases: no root is larger where this sum is below 1, and the last coefficient is the product of the roots
    if float((sizes / most ** np.arange(1, n + 1)).sum()) < 1 - 1e-9:
        return True
    if sizes[-1] > most**n * (1 + 1e-6):
        return False
    return bool((np.abs(np.roots(np.r_[1, -coefficients])) <= most).all())


def long_shocks(w: np.ndarray, long: int) -> np.ndarray:
    """Residuals of an autoregression over ``long`` values, which estimate the shocks."""
    design = np.hstack([np.ones((len(w) - long, 1)), lags(w, long, long)])
    shocks = np.zeros(len(w))
    shocks[long:] = w[long:] - design @ np.linalg.lstsq(design, w[long:], rcond=None)[0]
    return shocks


def without_shocks(e: list[float], ma: list[float], known: int) -> list[float]:
    """e[t] less the moving average of the ones before, from ``known`` on."""
    out = e[:known]
    put = out.append
    # the last values are names instead of places in a list, which takes half the time
    x, y, z = [*reversed(e[max(0, known - 3) : known]), 0.0, 0.0, 0.0][:3]
    c, d, f = [*ma, 0.0, 0.0, 0.0][:3]
    if len(ma) == 1:
        for v in e[known:]:
            x = v - c * x
            put(x)
    elif len(ma) == 2:
        for v in e[known:]:
            x, y = v - (c * x + d * y), x
            put(x)
    elif len(ma) == 3:
        for v in e[known:]:
            x, y, z = v - (c * x + d * y + f * z), x, y
            put(x)
    else:
        for v in e[known:]:
            put(v - sum(c * out[-i] for i, c in enumerate(ma, 1)))
    return out


def arma_fit(w: np.ndarray, p: int, q: int, constant: bool, start: int, known_shocks: dict | None = None) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Two-stage least squares: (AIC over the rows from ``start``, coefficients, residuals).

    A long autoregression estimates the shocks; values are then regressed on past values and
    shocks.  None where the rows are too few, the fit would explode or it is not invertible.  A root of
    1 is let through: a straight line is an autoregression with one.
    """
    long = min(max(p, q) + 2, len(w) // 3)
    if len(w) - start - long < p + q + 3:
        return None
    ones = lambda n: np.ones((n, 1))
    at = (constant, long)
    known_shocks = {} if known_shocks is None else known_shocks
    if q and at not in known_shocks:
        known_shocks[at] = long_shocks(w, long)
    shocks = known_shocks[at] if q else w
    first = long + max(p, q)
    design = np.hstack([ones(len(w) - first)] * constant + [lags(w, p, first), lags(shocks, q, first)])
    found = np.linalg.lstsq(design, w[first:], rcond=None)[0]
    ar, ma = found[constant : constant + p], found[constant + p :]
    if not (np.isfinite(found).all() and inside(ar, 1 + 1e-6) and inside(-ma, 0.999)):
        return None
    known = max(p, q)
    residuals = np.zeros(len(w))
    residuals[known:] = w[known:] - (found[0] if constant else 0.0) - lags(w, p, known) @ ar
    if q:
        residuals = np.array(without_shocks(residuals.tolist(), ma.tolist(), known))
    counted = residuals[start:]
    return len(counted) * np.log(max(float(np.mean(counted**2)), 1e-12)) + 2 * (p + q + constant + 1), found, residuals


def arima_values(x: np.ndarray, horizon: int, max_p: int = 3, max_q: int = 3) -> np.ndarray | None:
    """Forecast of the order (p, d, q) with the least AIC, d 0 or 1, p and q not both 0; None if no order fits.

    All orders are compared on the same last values.
    """
    x = np.maximum(x, FLOOR)
    most = max(1, len(x) // 4)
    best, shocks = None, {}
    skip = max(min(max_p, most), min(max_q, most))
    for p, d, q in product(range(min(max_p, most) + 1), (0, 1), range(min(max_q, most) + 1)):
        fit = arma_fit(np.diff(x, d), p, q, d == 0, skip + 1 - d, shocks) if p or q else None
        if fit and (best is None or fit[0] < best[0]):
            best = (fit[0], p, d, q, *fit[1:])
    if best is None:
        return None
    _, p, d, q, found, residuals = best
    w, e, constant = list(np.diff(x, d)), list(residuals), int(d == 0)
    for _ in range(horizon):
        past = [*w[::-1][:p], *e[::-1][:q]]
        w.append((found[0] if constant else 0.0) + float(np.dot(found[constant:], past)))
        e.append(0.0)
    ahead_ = np.array(w[-horizon:])
    return np.cumsum(ahead_) + x[-1] if d else ahead_


#: series that are fitted at once
TOGETHER = 16


def fitted(series: DataFrame, values: Callable[[list[np.ndarray]], list[np.ndarray]], unit: str = "day") -> DataFrame:
    """(series, ds, qty) for the days, or months (``unit``), after each series; ``values`` forecasts up to TOGETHER series at once."""
    ordered = series.select("series", "ds", F.coalesce("qty", F.lit(0.0)).alias("qty"))
    kind = ordered.schema["series"].dataType.simpleString()

    def rows(some: list[tuple]) -> pa.RecordBatch:
        found = values([x for _, _, x, _ in some])
        steps = [i for f in found for i in range(1, len(f) + 1)]
        sizes = [len(f) for f in found]
        keys = pa.array([k.as_py() for (k, *_), n in zip(some, sizes, strict=True) for _ in range(n)], some[0][0].type)
        days = pa.array([d.as_py() for (_, d, *_), n in zip(some, sizes, strict=True) for _ in range(n)], pa.date32())
        return pa.record_batch([keys, days, pa.array(steps, pa.int32()), pa.array(np.maximum(np.concatenate(found), 0.0))], ["series", "last_ds", "step", "qty"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = each_series(batches)
        while some := list(islice(runs, TOGETHER)):
            yield rows(some)

    move = F.add_months if unit == "month" else F.date_add
    found = in_runs(ordered).mapInArrow(fit, f"series {kind}, last_ds date, step int, qty double")
    return found.select("series", move("last_ds", F.col("step")).alias("ds"), F.round("qty", 2).alias("qty"))


def by_length(series: DataFrame) -> Callable[[Column], DataFrame]:
    """A function that picks the rows of the series whose number of rows ``n`` meets a condition."""
    counted = by_series(series.select("series", "ds", F.coalesce("qty", F.lit(0.0)).alias("qty"))).withColumn("n", F.count("*").over(per_series()))
    return lambda condition: counted.filter(condition).drop("n")


def short_average(series: DataFrame, horizon: int, unit: str = "day") -> DataFrame:
    """Mean of the last ``horizon`` rows or all, repeated for as many days."""
    back = F.row_number().over(per_series().orderBy(F.desc("ds")))
    level = series.withColumn("back", back).filter(F.col("back") <= horizon).groupBy("series").agg(F.max("ds").alias("last_ds"), F.round(F.avg("qty"), 2).alias("qty"), F.count("*").cast("int").alias("n"))
    return ahead(level, F.col("n"), unit).select("series", "ds", "qty")


def holt_winters(series: DataFrame, horizon: int = 7, period: int = 7, unit: str = "day") -> DataFrame:
    """Additive trend and season from two periods on, trend alone from four rows on, else the mean.

    Rows are ``unit`` (day or month) apart, here and below, and so are the forecast ones.
    """
    of = by_length(series)
    return fitted(of(F.col("n") >= 4), lambda xs: holt_winters_many(xs, horizon, period), unit).unionByName(short_average(of(F.col("n") < 4), horizon, unit))


def trend_values(x: np.ndarray, horizon: int) -> np.ndarray:
    """The line through the last 14 values, for as many days as it was fitted on, ``horizon`` at most."""
    y = x[-14:]
    slope, level = np.polyfit(np.arange(len(y)), y, 1)
    return level + slope * (len(y) + np.arange(min(len(y), horizon)))


def arima_or_trend(x: np.ndarray, horizon: int) -> np.ndarray:
    found = arima_values(x, horizon)
    return trend_values(x, horizon) if found is None else found


def auto_arima(series: DataFrame, horizon: int = 7, unit: str = "day") -> DataFrame:
    """ARIMA of the least AIC from four rows on, the trend where no order fits; smoothing for less than four rows."""
    of = by_length(series)
    return fitted(of(F.col("n") >= 4), lambda xs: [arima_or_trend(x, horizon) for x in xs], unit).unionByName(flat_smoothing_forecast(of(F.col("n") < 4), 0.3, horizon, unit))


def auto_seasonal(series: DataFrame, horizon: int = 7) -> DataFrame:
    """Holt-Winters from 14 rows on, a trend from 4 on, else the mean."""
    of = by_length(series)
    return fitted(of(F.col("n") >= 14), lambda xs: holt_winters_many(xs, horizon, 7)).unionByName(trend_forecast(of(F.col("n").between(4, 13)), 14, horizon)).unionByName(short_average(of(F.col("n") < 4), horizon))


def auto_regressive(series: DataFrame, horizon: int = 7, unit: str = "day") -> DataFrame:
    """ARIMA from 10 rows on, a trend from 4 on, else smoothing with 0.35."""
    of = by_length(series)
    return fitted(of(F.col("n") >= 10), lambda xs: [arima_or_trend(x, horizon) for x in xs], unit).unionByName(trend_forecast(of(F.col("n").between(4, 9)), 14, horizon, unit)).unionByName(flat_smoothing_forecast(of(F.col("n") < 4), 0.35, horizon, unit))


def trend_fallback(series: DataFrame, horizon: int = 7) -> DataFrame:
    """Trend of the last 30 rows, for ``horizon`` days."""
    return trend_forecast(series, 30, horizon)
