"""Forecasters over ordered series: arrays in, arrays out, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoloom.functions.arrays import mean


def naive(x: Column, horizon: int) -> Column:
    return F.array_repeat(F.element_at(x, -1), horizon)


def seasonal_naive(x: Column, horizon: int, period: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: F.get(x, F.size(x) - period + h % period))


def mean_forecast(x: Column, horizon: int) -> Column:
    return F.array_repeat(mean(x), horizon)


def drift(x: Column, horizon: int) -> Column:
    step = (F.element_at(x, -1) - F.element_at(x, 1)) / F.nullif(F.size(x) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.element_at(x, -1) + h * step)


def level(x: Column, alpha: float) -> Column:
    """Simple exponential smoothing from the first value."""
    rest = F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(x, 1), lambda l, v: alpha * v + (1 - alpha) * l)


def ses(x: Column, horizon: int, alpha: float) -> Column:
    return F.array_repeat(level(x, alpha), horizon)


def _state(x: Column, alpha: float, beta: float, phi: float) -> Column:
    """Level, trend and summed squared one-step errors of damped additive smoothing."""
    first = F.struct(
        F.element_at(x, 1).alias("l"), (F.element_at(x, 2) - F.element_at(x, 1)).alias("b"), F.lit(0.0).alias("sse")
    )

    def step(s, v):
        fit = s["l"] + phi * s["b"]
        new = alpha * v + (1 - alpha) * fit
        return F.struct(new.alias("l"), (beta * (new - s["l"]) + (1 - beta) * phi * s["b"]).alias("b"), (s["sse"] + (v - fit) * (v - fit)).alias("sse"))

    return F.aggregate(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), first, step)


def holt(x: Column, horizon: int, alpha: float, beta: float, phi: float = 1.0) -> Column:
    s = _state(x, alpha, beta, phi)
    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: s["l"] + s["b"] * (h if phi == 1 else phi * (1 - F.pow(F.lit(phi), h)) / (1 - phi)))


def ets_grid(x: Column, horizon: int, grid: list[tuple[float, float, float]]) -> Column:
    """Forecast of the (alpha, beta, phi) of ``grid`` with the least summed squared one-step error, the first at a tie."""
    fits = F.array(*[F.struct(_state(x, *p)["sse"].alias("sse"), F.lit(i).alias("i"), holt(x, horizon, *p).alias("f")) for i, p in enumerate(grid)])
    return F.array_min(fits)["f"]


def ets(x: Column, horizon: int, error: str = "additive", trend: str | None = None, season: str | None = None, period: int = 1, alpha: float = 0.1, beta: float = 0.01, gamma: float = 0.01, phi: float = 0.99) -> Column:
    """Exponential smoothing with an additive or multiplicative error, trend and season, each trend damped by ``phi``.

    Without data for a whole season (or two points for a trend) the forecast is null.
    """
    from chronoloom.operators.smoothing import smooth

    return smooth(x, horizon, error, trend, season, period, alpha, beta, gamma, phi)["forecast"]
