"""Accuracy, series profile, trend and autocorrelation, comparison of forecasts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .streamed import each_series, in_runs


def last_of_date(rows: DataFrame, order: str) -> DataFrame:
    """One row for each series and date: the qty of the highest ``order``."""
    return rows.groupBy("series", "ds").agg(F.max_by("qty", order).alias("qty"))


def accuracy(forecast: DataFrame, actual: DataFrame, order: str | None = None, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """MAE, MAPE, RMSE and sMAPE of each series (or of what ``by`` names: series and more columns of ``forecast``) over the dates both have; rounded to four places.

    Where a date may occur twice in a series, ``order`` names the column of both sides whose
    highest value counts; without it dates must be distinct.
    MAPE leaves out actual zeros (null if nothing else is left); sMAPE counts 0 against 0 as 0.
    Series without a common date have nulls and 0 points.
    """
    if order:
        forecast, actual = last_of_date(forecast, order), last_of_date(actual, order)
    f = forecast.select(*by, "ds", F.col("qty").alias("f"))
    both = f.join(actual.select("series", "ds", F.col("qty").alias("a")), ["series", "ds"], "left")
    error, scale = F.abs(F.col("f") - F.col("a")), F.abs("f") + F.abs("a")
    smape = F.when(F.col("a").isNull(), None).when(scale == 0, 0.0).otherwise(200 * error / scale)
    return both.groupBy(*by).agg(
        F.round(F.avg(error), 4).alias("mae"),
        F.round(100 * F.avg(F.when(F.col("a") != 0, error / F.abs("a"))), 4).alias("mape"),
        F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
        F.round(F.avg(smape), 4).alias("smape"),
        F.count("a").alias("data_points"),
    )


def profile(series: DataFrame) -> DataFrame:
    return series.groupBy("series").agg(
        F.round(F.avg("qty"), 4).alias("mean"),
        F.round(F.stddev_pop("qty"), 4).alias("std"),
        F.round(F.when(F.avg("qty") == 0, 0.0).otherwise(F.stddev_pop("qty") / F.avg("qty")), 4).alias("cv"),
        F.min("qty").alias("min"),
        F.max("qty").alias("max"),
        F.sum("qty").alias("total"),
        F.count_if(F.col("qty") == 0).alias("zero_days"),
        F.count_if(F.col("qty") != 0).alias("nonzero_days"),
    )


def trend_sum(q: np.ndarray) -> int:
    """Rising less falling ones of all ordered pairs, by halves: the later half is looked up in the sorted earlier one."""
    if len(q) <= 64:
        return int(np.triu(np.sign(q[None, :] - q[:, None]), 1).sum())
    first, second = q[: len(q) // 2], q[len(q) // 2 :]
    known = np.sort(first)
    across = np.searchsorted(known, second, "left").sum() + np.searchsorted(known, second, "right").sum() - len(first) * len(second)
    return trend_sum(first) + trend_sum(second) + int(across)


def trend_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(series, n, s, q): rows of each series, its ``trend_sum`` (null with a null quantity), and the quantities if there are less than four."""
    for some in iter(lambda runs=each_series(batches): list(islice(runs, 256)), []):
        few = [[None if nulls and np.isnan(v) else v for v in x.tolist()] if len(x) < 4 else [] for _, _, x, nulls in some]
        sums = [None if nulls and len(x) > 1 else trend_sum(x) for _, _, x, nulls in some]
        keys = pa.array([k.as_py() for k, *_ in some], some[0][0].type)
        yield pa.record_batch([keys, pa.array([len(x) for _, _, x, _ in some], pa.int32()), pa.array(sums, pa.int64()), pa.array(few, pa.list_(pa.float64()))], ["series", "n", "s", "q"])


def mann_kendall(series: DataFrame, critical: float = 1.96) -> DataFrame:
    """Trend by the sign of all ordered pairs (no tie correction).

    Under four rows z is null, and the trend is whether the mean of the second half, the longer
    one, is more than 10 % above or below the mean of the first (0 where that has no row).  Pairs are counted by sorting, inside each series.
    """
    kind = series.schema["series"].dataType.simpleString()
    s = in_runs(series).mapInArrow(trend_sums, f"series {kind}, n int, s long, q array<double>")
    n = F.col("n").cast("double")  # its third power is no int
    variance = n * (n - 1) * (2 * n + 5) / 18.0
    z = F.when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt(variance)).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt(variance)).otherwise(0.0)
    known = s.withColumn("z", F.when(F.col("n") >= 4, F.round(z, 4)))
    total = lambda q: F.aggregate(q, F.lit(0.0), lambda t, x: t + x)
    mid = F.floor(F.col("n") / 2).cast("int")
    first = F.when(mid > 0, total(F.slice("q", F.lit(1), mid)) / mid).otherwise(0.0)
    second = total(F.slice("q", mid + 1, F.col("n"))) / (F.col("n") - mid)
    few = F.when(second > first * 1.1, "rising").when(second < first * 0.9, "falling")
    trend = F.when(F.col("n") < 4, few).when(F.col("z") > critical, "rising").when(F.col("z") < -critical, "falling")
    return known.select("series", F.col("s").cast("bigint").alias("s"), "z", F.coalesce(trend, F.lit("stable")).alias("trend"))


def autocorrelation(series: DataFrame, most: int = 14) -> DataFrame:
    """Autocorrelation at lags 1 to min(n/2, ``most``) of series with ``most`` rows or more, rounded to three places."""
    whole, ordered = Window.partitionBy("series"), Window.partitionBy("series").orderBy("ds")
    centred = series.withColumns({"n": F.count("*").over(whole), "x": F.col("qty") - F.avg("qty").over(whole)}).filter(F.col("n") >= most)
    products = centred.select("series", "n", "x", *[(F.col("x") * F.lag("x", k).over(ordered)).alias(f"p{k}") for k in range(1, most + 1)])
    sums = products.groupBy("series").agg(F.max("n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("total"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, most + 1)])
    long = sums.select("series", "n", "total", F.posexplode(F.array(*[f"p{k}" for k in range(1, most + 1)])).alias("k", "p"))
    value = F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("p") / F.col("total"), 3) + 0.0)
    return long.filter(F.col("k") + 1 <= F.floor(F.col("n") / 2)).select("series", (F.col("k") + 1).alias("lag"), value.alias("acf"))


def best_lag(acf: DataFrame, least: float = 0.3) -> DataFrame:
    """The first lag with the highest autocorrelation, and whether it makes the series seasonal."""
    best = acf.groupBy("series").agg(F.max(F.struct("acf", (-F.col("lag")).alias("back"))).alias("x"))
    return best.select("series", (-F.col("x.back")).alias("lag"), "x.acf", (F.col("x.acf") > least).alias("seasonal"))


def recommend(profiles: DataFrame, trends: DataFrame, lags: DataFrame) -> DataFrame:
    """Which forecasts suit each series: seasonal first, then trend, then by how uneven it is."""
    seen = profiles.join(trends, "series", "left").join(lags, "series", "left")
    days = F.col("zero_days") + F.col("nonzero_days")
    picked = F.array_compact(
        F.array(
            F.when(F.col("seasonal") & (days >= 14), "holt_winters"),
            F.when(F.col("trend") != "stable", "linear_trend"),
            F.when(F.col("cv") > 0.5, "safety_stock_plan"),
            F.when(days >= 10, "auto_arima"),
            F.lit("moving_average"),
        )
    )
    return seen.select("series", picked.alias("presets"))


def suggested(profiles: DataFrame, trends: DataFrame, lags: DataFrame, critical: float = 1.96) -> DataFrame:
    """Parameters that suit each series: columns window (moving average), alpha, trend_window, period, horizon, z.

    The more uneven a series, the shorter its window and the higher its safety stock; a trend
    makes smoothing quicker, and a certain one the line longer.
    """
    seen = profiles.join(trends, "series", "left").join(lags, "series", "left")
    n, cv = (F.col("zero_days") + F.col("nonzero_days")).cast("int"), F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0)
    half, seasonal = F.floor(n / 2).cast("int"), F.coalesce("seasonal", F.lit(False))
    certain = F.coalesce(F.abs("z") > critical, F.lit(False))
    return seen.select(
        "series",
        F.when(cv < 0.2, F.least(F.lit(14), half)).when(cv < 0.5, F.least(F.lit(7), half)).otherwise(F.least(F.lit(3), F.greatest(F.lit(1), F.floor(n / 3).cast("int")))).alias("window"),
        F.when(F.coalesce("trend", F.lit("stable")) != "stable", 0.5).otherwise(0.2).alias("alpha"),
        F.least(n, F.when(certain, 30).otherwise(14)).alias("trend_window"),
        F.when(seasonal, F.col("lag").cast("int")).otherwise(7).alias("period"),
        F.when(seasonal, F.least(F.lit(14), half)).otherwise(7).alias("horizon"),
        F.when(cv > 0.5, 1.96).otherwise(1.65).alias("z"),
    )


def compare(forecasts: dict[str, DataFrame]) -> DataFrame:
    """Total, mean, extremes, days and first three values of several forecasts of the same series, and each forecast's mean total over all series."""
    labelled = [df.select("series", "ds", "qty", F.lit(name).alias("preset")) for name, df in forecasts.items()]
    first = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("ds", "qty"))), 1, 3), lambda p: p["qty"])
    each = reduce(DataFrame.unionByName, labelled).groupBy("series", "preset").agg(
        F.round(F.sum("qty"), 2).alias("total"), F.round(F.avg("qty"), 2).alias("average"), F.max("qty").alias("max"), F.min("qty").alias("min"), F.count("*").alias("days"), first.alias("first_3")
    )
    means = each.groupBy("preset").agg(F.round(F.avg("total"), 1).alias("mean_total"))
    return each.join(F.broadcast(means), "preset")  # a row a forecast
