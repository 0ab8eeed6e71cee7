"""Forecasts by name: each with its parameters, what else it reads, and how it may be spelled."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import DataFrame

from . import models, series


@dataclass(frozen=True)
class Preset:
    """``forecast`` takes (series, ds, qty), then the tables named in ``needs``, then parameters."""

    name: str
    forecast: Callable[..., DataFrame]
    params: Mapping[str, object] = field(default_factory=dict)
    aliases: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()


def folded(name: str) -> str:
    """Letters and digits of a name, without case: all else between words is a matter of taste."""
    return "".join(filter(str.isalnum, name.casefold()))


def registry(presets: Iterable[Preset]) -> Mapping[str, Preset]:
    """Every spelling, folded, to its preset.  A preset's own name wins over the alias of another; of equal names the last counts."""
    presets = list(presets)
    by_alias = {folded(alias): p for p in presets for alias in p.aliases}
    return MappingProxyType(by_alias | {folded(p.name): p for p in presets})


def named(name: str, known: Mapping[str, Preset]) -> Preset:
    """The preset of that name; a miss says which name comes closest."""
    try:
        return known[folded(name)]
    except KeyError:
        near = difflib.get_close_matches(folded(name), known, n=1, cutoff=0.0)
        raise LookupError(f"{name!r} is no preset" + (f", the closest is {known[near[0]].name}" if near else "")) from None


def forecast(rows: DataFrame, name: str, known: Mapping[str, Preset] | None = None, inputs: Mapping[str, DataFrame] | None = None, **params) -> DataFrame:
    """The forecast of that name over (series, ds, qty); ``params`` go before the preset's own, ``inputs`` holds the tables that it needs."""
    preset, inputs = named(name, PRESETS if known is None else known), inputs or {}
    if missing := [n for n in preset.needs if n not in inputs]:
        raise LookupError(f"{preset.name} needs {', '.join(missing)}")
    return preset.forecast(rows, *(inputs[n] for n in preset.needs), **{**preset.params, **params})


PRESETS = registry(
    [
        Preset("moving_average", series.flat_average_forecast, {"window": 7}),
        Preset("exponential_smoothing", series.flat_smoothing_forecast, {"alpha": 0.3}),
        Preset("linear_trend", series.trend_forecast, {"window": 30, "horizon": 30}, ("trend_forecast",)),
        Preset("safety_stock_plan", series.safety_stock_plan, {"window": 30, "z": 1.65}, ("safety_stock_planning",)),
        Preset("inventory_optimization", series.inventory_optimization, {"service_level": 0.95}),
        Preset("holt_winters", models.holt_winters, {"horizon": 7, "period": 7}),
        Preset("auto_arima", models.auto_arima, {"horizon": 7}, ("arima",)),
        Preset("auto_seasonal", models.auto_seasonal, {"horizon": 7}, ("zero_shot",)),
        Preset("auto_regressive", models.auto_regressive, {"horizon": 7}, ("chronos",)),
        Preset("trend_fallback", models.trend_fallback, {"horizon": 7}, ("timesfm",)),
        Preset("row_sums", series.daily_monthly_rollup, {}, ("daily_to_monthly_split",)),
        Preset("priority_fill", lambda rows, calls: series.priority_fill(calls, rows), needs=("calls",)),
        Preset("monthly_daily_blend", series.monthly_daily_blend, {"begin": 0.0}, needs=("monthly", "supply")),
        Preset("order_gap_blend", series.order_gap_blend, {"monthly": False}, needs=("totals",)),
    ]
)
