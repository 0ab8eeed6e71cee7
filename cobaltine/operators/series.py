"""Forecast and supply-plan operators over long series (series, ds, qty).

A series is a key column ``series``, a date ``ds`` and a double ``qty``, one row per date.
All of them work on every series in one job; windows are partitioned by series.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def per_series() -> WindowSpec:
    return Window.partitionBy("series")


def in_order() -> WindowSpec:
    return per_series().orderBy("ds")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


#: rows of a task
TASK_ROWS = 250_000


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt by ``by`` to tasks that grow with their number, so that what a task groups, sorts or joins does not."""
    return rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), *by)


def demand_series(rows: DataFrame, key: str, day: str, qty: str) -> DataFrame:
    """Sums to one row for each key and date."""
    return rows.groupBy(F.col(key).alias("series"), F.to_date(day).alias("ds")).agg(F.sum(qty).alias("qty"))


def tail(series: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each series, with ``i`` from 0 and the count ``n``."""
    back = F.row_number().over(per_series().orderBy(F.desc("ds")))
    last = series.withColumn("back", back).filter(F.col("back") <= n)
    return last.withColumn("n", F.count("*").over(per_series())).withColumn("i", F.col("n") - F.col("back")).drop("back")


def ahead(summary: DataFrame, horizon: Column | int, unit: str = "day") -> DataFrame:
    """One row for each day, or month (``unit``), after ``last_ds``, numbered ``step`` from 1."""
    steps = F.sequence(F.lit(1), F.lit(horizon) if isinstance(horizon, int) else horizon)
    move = F.add_months if unit == "month" else F.date_add
    return summary.withColumn("step", F.explode(steps)).withColumn("ds", move("last_ds", F.col("step")))


def moving_average(series: DataFrame, window: int = 7) -> DataFrame:
    return series.withColumn("value", F.avg("qty").over(in_order().rowsBetween(1 - window, 0)))


def cumulative_sum(series: DataFrame) -> DataFrame:
    return series.withColumn("value", F.sum("qty").over(so_far()))


def lagged(series: DataFrame, n: int = 1) -> DataFrame:
    return series.withColumn("value", F.lag("qty", n, 0.0).over(in_order()))


def smoothed(series: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(series, last_ds, value): the last exponentially smoothed value."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ds", "qty"))), lambda p: p["qty"])
    grouped = series.groupBy("series").agg(F.max("ds").alias("last_ds"), ordered.alias("q"))
    fold = F.aggregate("q", F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(x * alpha + s * (1 - alpha)))
    return grouped.select("series", "last_ds", fold.alias("value"))


def flat_average_forecast(series: DataFrame, window: int = 7) -> DataFrame:
    """Mean of the last ``window`` rows, for as many days."""
    level = tail(series, window).groupBy("series").agg(F.max("ds").alias("last_ds"), F.round(F.avg("qty"), 2).alias("qty"))
    return ahead(level, window).select("series", "ds", "qty")


def flat_smoothing_forecast(series: DataFrame, alpha: float = 0.3, horizon: int = 7, unit: str = "day") -> DataFrame:
    return ahead(smoothed(series, alpha), horizon, unit).select("series", "ds", F.round("value", 2).alias("qty"))


def trend_forecast(series: DataFrame, window: int = 30, horizon: int = 30, unit: str = "day") -> DataFrame:
    """The line through the last ``window`` rows, never below zero, for as many days (or months) as it was fitted on."""
    fit = tail(series, window).groupBy("series").agg(F.max("ds").alias("last_ds"), F.max("n").alias("n"), F.avg("qty").alias("mean"), F.regr_slope("qty", "i").alias("slope"))
    steps = ahead(fit, F.least(F.col("n"), F.lit(horizon)).cast("int"), unit)
    # the line's value at position n - 1 + step, written from its middle
    value = F.col("mean") + F.coalesce("slope", F.lit(0.0)) * (F.col("step") + (F.col("n") - 1) / 2.0)
    return steps.select("series", "ds", F.round(F.greatest(F.lit(0.0), value), 2).alias("qty"))


def seasonal_index(series: DataFrame, period: int = 7) -> DataFrame:
    """Mean of each position over the complete periods, relative to the mean of all rows."""
    placed = series.withColumn("i", F.row_number().over(in_order()) - 1).withColumn("n", F.count("*").over(per_series())).withColumn("mean", F.avg("qty").over(per_series()))
    complete = placed.filter(F.col("i") < F.floor(F.col("n") / period) * period)
    index = F.when(F.max("mean") == 0, 1.0).otherwise(F.avg("qty") / F.max("mean"))
    return complete.groupBy("series", (F.col("i") % period).alias("position")).agg(index.alias("value"))


def running_balance(moves: DataFrame, begin: float = 0.0) -> DataFrame:
    """Stock after each row of (series, ds, demand, supply); it may fall below zero."""
    return moves.withColumn("balance", F.lit(begin) + F.sum(F.col("supply") - F.col("demand")).over(so_far()))


def clamped_balance(moves: DataFrame, begin: Column | float = 0.0) -> DataFrame:
    """Stock that never falls below zero.

    ``raw`` is the balance of a row before it is cut off at zero, ``stock`` after it, and
    ``net`` what was missing.  With the unclamped sums W, the stock is W - min(0, smallest W
    so far): two windows instead of a recursion.
    """
    begin = F.lit(begin) if isinstance(begin, float | int) else begin
    summed = moves.withColumn("w", begin + F.sum(F.col("supply") - F.col("demand")).over(so_far()))
    stock = summed.withColumn("stock", F.col("w") - F.least(F.lit(0.0), F.min("w").over(so_far())))
    raw = F.coalesce(F.lag("stock").over(in_order()), begin) + F.col("supply") - F.col("demand")
    return stock.withColumn("raw", raw).withColumn("net", F.greatest(F.lit(0.0), -F.col("raw"))).drop("w")


def safety_stock_plan(series: DataFrame, window: int = 30, z: float = 1.65, begin: float = 0.0, deliveries: DataFrame | None = None) -> DataFrame:
    """Daily shipments that keep mean demand plus z deviations covered, from a stock that mean demand draws down.

    ``deliveries`` (series, step, qty) are what is on its way and arrives on the step-th day
    ahead; it lessens that day's shipment and adds to the stock.  A day without a row gets none.
    """
    level = tail(series, window).groupBy("series").agg(F.max("ds").alias("last_ds"), F.max("n").alias("n"), F.avg("qty").alias("demand"), F.stddev_pop("qty").alias("deviation"))
    days = ahead(level, F.least(F.col("n"), F.lit(30)).cast("int"))
    if deliveries is None:
        days = days.withColumn("supply", F.lit(0.0))
    else:
        arriving = deliveries.groupBy("series", "step").agg(F.sum("qty").alias("supply"))
        days = days.join(arriving, ["series", "step"], "left").withColumn("supply", F.coalesce("supply", F.lit(0.0)))
    # raw is the stock before the day plus its delivery less mean demand
    ship = F.greatest(F.lit(0.0), z * F.col("deviation") - F.col("raw"))
    return clamped_balance(days, begin).select("series", "ds", F.round(ship, 2).alias("qty"), F.round("stock", 2).alias("inventory"))


def inventory_optimization(series: DataFrame, service_level: float = 0.95, **params) -> DataFrame:
    return safety_stock_plan(series, z=NormalDist().inv_cdf(service_level), **params)


def priority_fill(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """``primary`` where it is above zero, else ``fallback``; rows of ``fallback``."""
    p = primary.select("series", "ds", F.col("qty").alias("first"))
    return fallback.join(p, ["series", "ds"], "left").select("series", "ds", F.when(F.col("first") > 0, F.col("first")).otherwise(F.col("qty")).alias("qty"))


def jit_priority_fill(days: DataFrame, totals: DataFrame, divide_by_weeks: bool = True) -> DataFrame:
    """Fixed calls win over demand; what a week's total leaves goes to the days without a call.

    ``days`` has series, ds, demand, jit and pgi (already delivered); ``totals`` series and
    total, for all weeks together (``divide_by_weeks``) or for each.  Weeks are ISO weeks.
    """
    week = Window.partitionBy("series", "year", "week")
    placed = days.withColumns({"year": F.extract(F.lit("YEAROFWEEK"), "ds"), "week": F.weekofyear("ds"), "fixed": F.when(F.col("jit") > 0, F.col("jit")).otherwise(F.col("demand"))})
    weeks = placed.groupBy("series").agg(F.countDistinct("year", "week").alias("weeks")).join(totals, "series")
    weekly = F.col("total") / F.col("weeks") if divide_by_weeks else F.col("total")
    known = placed.join(weeks.select("series", weekly.alias("weekly")), "series")
    rest = F.col("weekly") - F.sum("pgi").over(week) - F.sum("fixed").over(week)
    free = F.sum(F.when(F.col("jit") > 0, 0).otherwise(1)).over(week)
    filled = known.withColumns({"rest": rest, "free": free})
    extra = F.when((F.col("jit") <= 0) & (F.col("rest") > 0), F.col("rest") / F.col("free")).otherwise(0.0)
    return filled.select("series", "ds", F.round(F.greatest(F.lit(0.0), F.col("fixed") + extra), 2).alias("qty"))


def monthly_daily_blend(demand: DataFrame, monthly: DataFrame, supply: DataFrame, begin: float = 0.0, digits: int = 2) -> DataFrame:
    """Daily demand where there is some; elsewhere the rest of the month's forecast, spread evenly; then the stock balance.

    ``monthly`` has series, month (its first day) and forecast.  The calendar runs from the
    first demand, or the first forecast month, to the end of the last forecast month.  A
    month's fill may be negative.  Days in months without a forecast have demand only.
    """
    none = F.lit(None).cast("double")
    side = lambda df, day, **c: df.select("series", F.col(day).alias("ds"), *[c.get(n, none).alias(n) for n in ("qty", "supply", "forecast")], F.lit("qty" in c).alias("asked"), F.lit("forecast" in c).alias("starts"))
    given = side(demand, "ds", qty=F.col("qty")).unionByName(side(supply, "ds", supply=F.col("qty"))).unionByName(side(monthly, "month", forecast=F.col("forecast"))).filter("ds is not null")
    # one shuffle, by series; dates that nobody names are made behind it
    sums = [F.sum(c).alias(c) for c in ("qty", "supply", "forecast")]
    rows = given.repartition("series").groupBy("series", "ds").agg(*sums, F.count_if("asked").alias("asked"), F.max("starts").alias("starts")).withColumn("month", F.trunc("ds", "MM"))
    # one order for all of them, so that rows are sorted once
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_month, of_series = Window.partitionBy("series", "month").orderBy("ds"), per_series().orderBy("month", "ds")
    free = F.day(F.last_day("ds")) - F.sum("asked").over(whole(of_month))
    rest = F.sum("forecast").over(whole(of_month)) - F.coalesce(F.sum("qty").over(whole(of_month)), F.lit(0.0))
    fill = F.when(F.max("starts").over(whole(of_month)), F.when(free > 0, rest / free).otherwise(0.0))
    begins = F.min(F.when(F.col("starts") | (F.col("asked") > 0), F.col("ds"))).over(whole(of_series))
    ends = F.last_day(F.max(F.when(F.col("starts"), F.col("ds"))).over(whole(of_series)))
    known = rows.withColumns({"fill": fill, "begins": begins, "ends": ends, "next": F.lead("ds").over(of_series)}).filter(F.col("ds").between(F.col("begins"), F.col("ends")))
    # a month with a forecast has a row on its first day, so a date without a row takes the fill of the row before it, if that is of its month
    until = F.least(F.date_sub("next", 1), F.col("ends"))
    days = known.select("series", "qty", "fill", "supply", "month", F.col("ds").alias("named"), F.explode(F.sequence("ds", until)).alias("ds"))
    is_named = F.col("ds") == F.col("named")
    fills = F.when(F.trunc("ds", "MM") == F.col("month"), F.col("fill"))
    moves = days.select("series", "ds", F.coalesce(F.when(is_named, F.col("qty")), fills, F.lit(0.0)).alias("demand"), F.coalesce(F.when(is_named, F.col("supply")), F.lit(0.0)).alias("supply"))
    return clamped_balance(moves, begin).select("series", "ds", F.round("net", digits).alias("qty"), F.round("raw", digits).alias("balance"))


def blend_forecasts(demand: DataFrame, totals: DataFrame, by_month: DataFrame) -> DataFrame:
    """(series, month, forecast) for ``monthly_daily_blend``, from the forecasts that a series has.

    ``by_month`` (series, month, forecast) where it has rows; else ``totals`` (series,
    forecast) for the month of the first demand; where that is null or 0, the mean of the
    positive demand is that month's total.  A series with none of these has no row.
    """
    first = demand.groupBy("series").agg(F.trunc(F.min("ds"), "MM").alias("month"), F.avg(F.when(F.col("qty") > 0, F.col("qty"))).alias("mean"))
    single = first.join(by_month.select("series").distinct(), "series", "left_anti").join(totals.select("series", "forecast"), "series", "left")
    value = F.when(F.col("forecast") != 0, F.col("forecast")).otherwise(F.col("mean"))
    return by_month.select("series", "month", "forecast").unionByName(single.select("series", "month", value.alias("forecast")).filter("forecast is not null"))


def first_source(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of ``first``, and those of ``second`` for series that have none there."""
    return first.unionByName(second.join(first.select("series").distinct(), "series", "left_anti").select(first.columns))


def monthly_split(monthly: DataFrame, delivered: DataFrame) -> DataFrame:
    """What the current month still needs, booked on the next month: first forecast less what was delivered, not below zero.

    ``monthly`` has series, month and forecast, ``delivered`` series and qty.
    """
    first = monthly.groupBy("series").agg(F.min(F.struct("month", "forecast")).alias("x")).select("series", "x.*")
    left = first.join(delivered, "series", "left")
    return left.select("series", F.add_months("month", 1).alias("month"), F.round(F.greatest(F.lit(0.0), F.col("forecast") - F.coalesce("qty", F.lit(0.0))), 2).alias("qty"))


def daily_monthly_rollup(series: DataFrame) -> DataFrame:
    """Days and months in one table; period is yyyyMMdd or yyyyMM."""
    # grouped by dates, which take less memory than their texts
    spans = F.array(F.struct(F.lit(False).alias("months"), F.to_date("ds").alias("start")), F.struct(F.lit(True).alias("months"), F.trunc("ds", "MM").alias("start")))
    both = series.select("series", "qty", F.explode(spans).alias("x")).groupBy("series", "x.months", "x.start").agg(F.sum("qty").alias("qty"))
    period = F.when(F.col("months"), F.date_format("start", "yyyyMM")).otherwise(F.date_format("start", "yyyyMMdd"))
    return both.select("series", F.when(F.col("months"), "monthly").otherwise("daily").alias("type"), period.alias("period"), "qty")


def row_merge_freeze(rows: DataFrame, monthly: DataFrame) -> DataFrame:
    """Daily sums of the positive (site, vendor, part, ds) totals, and the months that have no daily row.

    ``monthly`` has month (yyyyMM) and qty.
    """
    merged = rows.groupBy("site", "vendor", "part", "ds").agg(F.sum("qty").alias("qty")).filter("qty > 0")
    daily = merged.groupBy("ds").agg(F.sum("qty").alias("qty")).select(F.date_format("ds", "yyyyMMdd").alias("period"), "qty", F.lit("daily").alias("type"))
    months = daily.select(F.substring("period", 1, 6).alias("month")).distinct()
    rest = monthly.groupBy("month").agg(F.sum("qty").alias("qty")).join(months, "month", "left_anti")
    return daily.unionByName(rest.select(F.col("month").alias("period"), "qty", F.lit("monthly").alias("type")))


def order_gap_blend(orders: DataFrame, totals: DataFrame, monthly: bool = False) -> DataFrame:
    """Days of the first order's period, with what is still missing of the forecast spread over its last days.

    ``orders`` has series, ds and qty, ``totals`` series, forecast and delivered (0 where there
    is no row).  Where the last of all orders is on or past the period's end, each day is its
    order or 0, of type daily_order, and nothing is spread.  Else:

    * by week, Monday to Sunday: the Sunday is forecast less deliveries and orders, which may
      be negative;
    * ``monthly``, first order to the month's end: the forecast is what remains, and is spread
      evenly from the day of the last order, whose quantity it replaces, to the end.

    Types: daily_order, spread and empty.
    """
    start, end = (F.min("ds"), F.last_day(F.min("ds"))) if monthly else (F.date_trunc("week", F.min("ds")).cast("date"), F.date_add(F.date_trunc("week", F.min("ds")).cast("date"), 6))
    period = orders.groupBy("series").agg(start.alias("start"), end.alias("end"), F.max("ds").alias("last"), F.sum("qty").alias("ordered")).join(totals.select("series", "forecast", "delivered"), "series", "left")
    forecast = F.coalesce("forecast", F.lit(0.0))
    # an order on the day after the end would divide by zero, and nothing is spread there
    share = F.when(F.col("last") < F.col("end"), forecast / (F.datediff("end", "last") + 1)) if monthly else forecast - F.coalesce("delivered", F.lit(0.0)) - F.col("ordered")
    spread_from = F.when(F.col("last") < F.col("end"), F.col("last") if monthly else F.col("end"))
    days = period.select("series", F.explode(F.sequence("start", "end")).alias("ds"), (F.col("last") >= F.col("end")).alias("covered"), spread_from.alias("spread_from"), share.alias("share"))
    kind = F.when(F.col("ds") >= F.col("spread_from"), "spread").when(F.col("covered") | F.col("qty").isNotNull(), "daily_order").otherwise("empty")
    qty = F.when(F.col("ds") >= F.col("spread_from"), F.col("share")).otherwise(F.coalesce("qty", F.lit(0.0)))
    return days.join(orders.select("series", "ds", "qty"), ["series", "ds"], "left").select("series", "ds", F.round(qty, 2).alias("qty"), kind.alias("type"))


def topdown_by_bom(vehicles: DataFrame, bom: DataFrame) -> DataFrame:
    """Part demand from vehicle volumes: volume times take rate times usage; missing rates count as 1."""
    one = lambda c: F.coalesce(c, F.lit(1.0))
    return vehicles.join(bom, "vehicle").groupBy("part", "month").agg(F.sum(F.col("volume") * one("take_rate") * one("usage")).alias("qty"))


def topdown_by_product(volumes: DataFrame, shares: DataFrame, delivered: DataFrame, planned: DataFrame, season: DataFrame) -> DataFrame:
    """Monthly demand of parts from yearly product demand.

    ``volumes`` (brand, volume) times ``shares`` (brand, product, share) gives each product's
    demand; ``planned`` (product, part, month, qty), parts that start or end, comes off it.
    The rest goes to the running parts by their part of ``delivered`` (product, part, qty),
    a twelfth a month.  Both are multiplied by ``season`` (month, factor), 1 where it has no
    row.  Returns product, part, month, qty and type (``running`` or ``planned``).
    """
    total = volumes.join(shares, "brand").groupBy("product").agg(F.sum(F.col("volume") * F.col("share")).alias("demand"))
    off = planned.groupBy("product").agg(F.sum("qty").alias("off"))
    rest = total.join(off, "product", "left").select("product", (F.col("demand") - F.coalesce("off", F.lit(0.0))).alias("rest"))
    parts = delivered.groupBy("product", "part").agg(F.sum("qty").alias("part_qty")).join(delivered.groupBy("product").agg(F.sum("qty").alias("product_qty")), "product")
    monthly = F.when(F.col("product_qty") == 0, 0.0).otherwise(F.col("rest") * F.col("part_qty") / F.col("product_qty") / 12)
    running = parts.join(rest, "product").select("product", "part", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), monthly.alias("qty"), F.lit("running").alias("type"))
    both = running.unionByName(planned.select("product", "part", "month", "qty", F.lit("planned").alias("type")))
    factor = F.coalesce("factor", F.lit(1.0))
    return both.join(season.select("month", "factor"), "month", "left").select("product", "part", "month", F.round(F.col("qty") * factor, 2).alias("qty"), "type")
