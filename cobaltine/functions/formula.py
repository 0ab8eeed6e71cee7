"""Series functions over ``array<double>`` columns: one array per record, oldest value first.

Each is a Column expression, so a formula over a record is an ordinary projection.  Arithmetic
between arrays of different length pads the shorter one with zeros; an array of one value,
like a scalar, applies to every position.  An empty array gives an empty array or 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantities(points: Column) -> Column:
    """Values of an array of (date, qty) structs; a missing qty is 0."""
    return F.transform(points, lambda p: F.coalesce(p["qty"], F.lit(0.0)))


def elementwise(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    stretch = lambda x: F.when(F.size(x) == 1, F.array_repeat(x[0], longest)).otherwise(x)
    return F.zip_with(stretch(a), stretch(b), lambda x, y: op(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))


def divide(x: Column, y: Column) -> Column:
    return F.when(y == 0, 0.0).otherwise(x / y)


def modulo(x: Column, y: Column) -> Column:
    """Floored: the result has the sign of ``y``; 0 where ``y`` is."""
    return F.when(y == 0, 0.0).otherwise(x - F.floor(x / y) * y)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; written out in a function over elements, it would be computed for each."""
    return F.transform(F.array(value), body)[0]


def scanned(a: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states (doubles) after each element of a fold from ``start``.

    An array grows by being copied, so states are collected in blocks of the root of the length.
    """

    def of(a: Column, width: Column) -> Column:
        def block(s: Column, i: Column) -> Column:
            # the state before the block comes first and is cut off again
            states = F.aggregate(F.slice(a, i, width), F.array(s["last"]), lambda t, x: F.array_append(t, step(F.element_at(t, -1), x)))
            return let(states, lambda t: F.struct(F.element_at(t, -1).alias("last"), F.array_append(s["done"], F.slice(t, 2, F.size(t) - 1)).alias("done")))

        first = F.struct(start.cast("double").alias("last"), F.array().cast("array<array<double>>").alias("done"))
        return F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(a), width), first, block)["done"])

    whole = let(a, lambda x: let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda width: of(x, width)))
    return F.when(F.size(a) == 0, F.array().cast("array<double>")).otherwise(whole)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(total(a) / F.size(a))


def smallest(a: Column) -> Column:
    return F.coalesce(F.array_min(a), F.lit(0.0))


def largest(a: Column) -> Column:
    return F.coalesce(F.array_max(a), F.lit(0.0))


def deviation(a: Column) -> Column:
    """Of the population."""
    squares = lambda m: total(F.transform(a, lambda x: (x - m) * (x - m)))
    return F.when(F.size(a) == 0, 0.0).otherwise(F.sqrt(let(mean(a), squares) / F.size(a)))


def safety_stock(a: Column, z: float = 1.65) -> Column:
    return deviation(a) * z


def positions(a: Column) -> Column:
    return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(a)))


def moving_average(a: Column, window: int = 7) -> Column:
    """Trailing mean; the first positions average what there is."""
    return F.transform(positions(a), lambda i: mean(F.slice(a, F.greatest(i - (window - 1), F.lit(1)), F.least(i, F.lit(window)))))


def exponential_smoothing(a: Column, alpha: float = 0.3) -> Column:
    """All smoothed values, starting from the first one."""
    rest = scanned(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.get(a, F.lit(0)), lambda s, x: x * alpha + s * (1 - alpha))
    return F.when(F.size(a) == 0, a).otherwise(F.concat(F.slice(a, 1, 1), rest))


def linear_trend(a: Column, window: int = 30) -> Column:
    """The values, followed by as many extrapolated from the line through the last ``window`` ones."""
    n = F.least(F.size(a), F.lit(window))
    tail = F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)
    mid = (n - 1) / 2.0
    cross = total(F.transform(tail, lambda y, i: (i - mid) * y))
    spread = total(F.transform(tail, lambda y, i: (i - mid) * (i - mid)))
    slope = F.when(spread == 0, 0.0).otherwise(cross / spread)
    line = F.struct(mean(tail).alias("mean"), slope.alias("slope"))
    ahead = let(line, lambda f: F.transform(F.sequence(F.lit(0), n - 1), lambda i: f["mean"] + f["slope"] * (n + i - mid)))
    return F.when(F.size(a) == 0, a).otherwise(F.concat(a, ahead))


def seasonal_index(a: Column, period: int = 7) -> Column:
    """Mean of each position over the complete periods, relative to the mean of the whole array."""
    full = F.floor(F.size(a) / period).cast("int")
    m = mean(a)
    of = lambda p: total(F.transform(F.sequence(F.lit(0), full - 1), lambda k: F.get(a, (k * period + p).cast("int")))) / full / m
    each = F.transform(F.sequence(F.lit(0), F.lit(period - 1)), of)
    return F.when((full == 0) | (m == 0), F.array_repeat(F.lit(1.0), period)).otherwise(each)


def shift(a: Column, n: int = 1) -> Column:
    """Forward, zeros are put before the array and it grows; backward, zeros replace what falls off its start."""
    if n >= 0:
        return F.concat(F.array_repeat(F.lit(0.0), n), a)
    gone = F.least(F.size(a), F.lit(-n))
    return F.concat(F.slice(a, gone + 1, F.size(a) - gone), F.array_repeat(F.lit(0.0), -n))


def cumulative_sum(a: Column) -> Column:
    # as before, a null counts as 0 in the sums after it
    return scanned(a, F.lit(0.0), lambda s, x: F.coalesce(s, F.lit(0.0)) + x)


def held_last(a: Column, size: Column) -> Column:
    """Stretches an array to a size by its last value (0 if it has none)."""
    return F.concat(a, F.array_repeat(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)), F.greatest(size - F.size(a), F.lit(0))))


def padded(a: Column, size: Column) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(size - F.size(a), F.lit(0))))


def balance(begin: Column, demand: Column, supply: Column) -> Column:
    """Running stock, which may fall below zero; demand goes on with its last value."""
    size = F.greatest(F.size(demand), F.size(supply))
    moves = F.zip_with(padded(supply, size), held_last(demand, size), lambda s, d: s - d)
    return F.transform(cumulative_sum(moves), lambda x: begin + x)


def net_demand(balances: Column) -> Column:
    return F.transform(balances, lambda b: F.greatest(F.lit(0.0), -b))


def inventory_planning(forecast: Column, begin: Column, supply: Column) -> Column:
    """What has to be shipped at each position: demand that stock and supply do not cover."""
    size = F.greatest(F.size(forecast), F.size(supply))
    pairs = F.arrays_zip(held_last(forecast, size).alias("d"), padded(supply, size).alias("p"))

    def planned(pairs: Column) -> Column:
        stocks = scanned(pairs, begin, lambda stock, x: F.greatest(F.lit(0.0), stock + x["p"] - x["d"]))
        before = F.concat(F.array(begin.cast("double")), stocks)
        return F.zip_with(pairs, F.slice(before, 1, F.size(pairs)), lambda x, stock: F.greatest(F.lit(0.0), x["d"] - stock - x["p"]))

    return let(pairs, planned)


def blended_demand(daily: Column, begin: Column, supply: Column) -> Column:
    """What stock and supply leave uncovered of each day's demand, rounded to cents; supply beyond the days does not count.

    Every position has a demand of its own here, so a monthly forecast adds nothing.
    """
    short = inventory_planning(daily, begin, F.slice(supply, 1, F.size(daily)))
    return F.when(F.size(daily) == 0, daily).otherwise(F.transform(short, lambda x: F.round(x, 2)))


def jit_fill(weekly: Column, daily: Column, jit: Column, supply: Column) -> Column:
    """Fixed calls win over daily demand; what the weekly total leaves is spread over the positions without a call."""
    size = F.greatest(F.size(daily), F.size(jit))
    fixed = F.zip_with(padded(jit, size), padded(daily, size), lambda j, d: F.struct(j.alias("jit"), F.when(j > 0, j).otherwise(d).alias("qty")))

    def filled(fixed: Column) -> Column:
        free = F.size(F.filter(fixed, lambda x: x["jit"] <= 0))
        rest = weekly - total(supply) - total(F.transform(fixed, lambda x: x["qty"]))
        extra = let(rest, lambda r: let(free, lambda n: F.when((r > 0) & (n > 0), r / n).otherwise(0.0)))
        return let(extra, lambda more: F.transform(fixed, lambda x: F.round(F.greatest(F.lit(0.0), F.when(x["jit"] > 0, x["qty"]).otherwise(x["qty"] + more)), 2)))

    return let(fixed, filled)


#: name: (function, what it takes)
CATALOG: dict[str, tuple[Callable, str]] = {
    "sum": (total, "series"),
    "mean": (mean, "series"),
    "min": (smallest, "series"),
    "max": (largest, "series"),
    "std": (deviation, "series"),
    "safety_stock": (safety_stock, "series, z=1.65"),
    "moving_average": (moving_average, "series, window=7"),
    "exponential_smoothing": (exponential_smoothing, "series, alpha=0.3"),
    "linear_trend": (linear_trend, "series, window=30"),
    "seasonal_index": (seasonal_index, "series, period=7"),
    "shift": (shift, "series, n=1"),
    "cumsum": (cumulative_sum, "series"),
    "balance": (balance, "begin, demand, supply"),
    "net_demand": (net_demand, "balance"),
    "inventory_planning": (inventory_planning, "forecast, begin, supply"),
    "jit_fill": (jit_fill, "weekly, daily, jit, supply"),
    "blended_demand": (blended_demand, "daily, begin, supply"),
    "if_then_else": (lambda c, a, b: F.when(c, a).otherwise(b), "condition, a, b"),
    "round": (F.round, "value, digits=0"),
    "abs": (F.abs, "value"),
}
